"""Operator 6: license scans by an exact set-similarity join of text blocks with templates.

A block is a line of a text, or a window of words that crosses line breaks and is as long as the template and
WIDER, as the set of its words; it holds a template if it has at least CONTAINED of the template's words. The words of each template are ordered by how often they occur in all documents,
rarest first. A block that holds a template must have one of the first words in this order (prefix filter),
enough words (length filter), and enough words of both sides behind the first common one (positional
filter); whatever passes is counted exactly, so no block is missed. Of windows that overlap, the
first with the largest share counts, unless a line has as much there; it ends with the word that completes its share, and the
search goes on behind it, so that notices in a row are a block each. Beside this, fixed phrases are found
wherever their words stand consecutively.

Defined cases: null is empty and has no words; blank lines are no blocks; a repeated line counts each time;
every row is judged by itself; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow_schema, as_batch, mapped, passes, row_sig
from .words import ALNUM, Words

CONTAINED = 0.8
#: Words of a window for each word of a template: room for comment marks and for what is put in.
WIDER = 1.25
#: Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: License notices and the labels that a block holding one gets; whole paragraphs of public license texts and headers among them.
TEMPLATES = {
    "apache-notice": "licensed under the apache license version 2 0",
    "apache-terms": "you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "apache-warranty": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "bsd-terms": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-warranty": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "cc-notice": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-nc-notice": "licensed under cc by nc 4 0",
    "gpl-notice": "this work is licensed under the gnu general public license version 3",
    "gpl-terms": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gpl-warranty": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
    "mit-notice": "released under the mit license",
    "mit-terms": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "mpl-terms": "this source code form is subject to the terms of the mozilla public license v 2 0",
}


def word_hash(words: list[str]) -> np.ndarray:
    raw = " ".join(words).encode()
    return Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), ALNUM, lower=True).hashes()


class Vocabulary:
    """All words of phrases and templates; a word's id is its place in hash order."""

    def __init__(self, templates: dict[str, str], phrases: dict[str, str] = PHRASES):
        self.words = sorted({w for text in [*templates, *phrases] for w in (templates.get(text) or text).split()})
        hashes = word_hash(self.words)
        order = np.argsort(hashes)
        self.hashes, self.id = hashes[order], {self.words[k]: i for i, k in enumerate(order.tolist())}
        self.phrases = [([self.id[w] for w in p.split()], label) for p, label in phrases.items()]
        self.sets = {label: {self.id[w] for w in text.split()} for label, text in templates.items()}
        self.span = {label: math.ceil(WIDER * len(text.split())) for label, text in templates.items()}

    def ids(self, w: Words) -> np.ndarray:
        """Each word's id, or -1."""
        h = w.hashes()
        at = np.searchsorted(self.hashes, h)
        at[at == len(self.hashes)] = 0
        return np.where(self.hashes[at] == h, at, -1)


class Index:
    """Templates in global frequency order, by the words of their prefixes."""

    def __init__(self, sets: dict[str, set[int]], counts: np.ndarray, contained: float = CONTAINED):
        self.rank = np.empty(len(counts), np.int64)
        self.rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))
        self.of: dict[int, list[tuple[str, int]]] = {}
        self.prefix = np.zeros(len(counts) + 1, bool)  # the last is for words outside
        self.sets, self.need, self.member, self.first = sets, {}, {}, {}
        for label, own in sets.items():
            self.member[label], self.first[label] = np.zeros(len(counts) + 1, bool), np.zeros(len(counts) + 1, bool)
            self.member[label][list(own)] = True
            self.need[label] = need = math.ceil(contained * len(own) - 1e-9)
            for i, word in enumerate(sorted(own, key=self.rank.__getitem__)[: len(own) - need + 1]):
                self.of.setdefault(word, []).append((label, i))
                self.prefix[word] = self.first[label][word] = True

    def match(self, known: set[int], size: int) -> dict[str, float]:
        """Templates that a block holds: known has its ids in the vocabulary, size is its number of distinct words."""
        out: dict[str, float] = {}
        met: set[str] = set()
        for word in sorted(known, key=self.rank.__getitem__):
            for label, i in self.of.get(word, ()):
                need, own = self.need[label], self.sets[label]
                if label in met:
                    continue
                met.add(label)  # its rarest common word: what follows bounds the overlap
                # Words outside the vocabulary may come before or after in global order, so all of them may precede.
                behind = sum(self.rank[k] > self.rank[word] for k in known)
                if size < need or 1 + min(len(own) - i - 1, behind) < need:
                    continue
                share = len(own & known) / len(own)
                if len(own & known) >= need:
                    out[label] = share
        return out


def frequencies(docs: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """How often each word of the vocabulary occurs in all documents."""
    arrow = arrow_schema("word int, n long")

    def count(batches):
        total = np.zeros(len(vocabulary.hashes), np.int64)
        for batch in batches:
            for _, _, data, off in passes(batch.column(0)):
                at = vocabulary.ids(Words(data, off, ALNUM, lower=True))
                total += np.bincount(at[at >= 0], minlength=len(total))
        some = np.flatnonzero(total)
        yield as_batch([some, total[some]], arrow)

    out = np.zeros(len(vocabulary.hashes), np.int64)
    for word, n in docs.select("text").mapInArrow(count, "word int, n long").groupBy("word").agg(F.sum("n")).collect():  # a row a word
        out[word] = n
    return out


def windows(at: np.ndarray, w: Words, line: np.ndarray, label: str, span: int, index: Index) -> list[tuple[int, int, float]]:
    """(first word, word after the last, share) of blocks across lines that hold a template, from left to right, none overlapping.

    A block starts where the best window does that overlaps the first one left (the first of equals), and ends with the word that
    completes its share, so that a notice that follows at once is a block of its own.
    """
    member, need, size = index.member[label][at], index.need[label], len(index.sets[label])
    total, rare = (np.concatenate([[0], np.cumsum(x)]) for x in (member, index.first[label][at]))
    a = np.flatnonzero(member)
    b = np.minimum(a + span, w.at[w.doc[a] + 1])
    some = (total[b] - total[a] >= need) & (rare[b] > rare[a]) & (line[a] != line[b - 1])  # length and prefix filters
    found = []
    for i, j in zip(a[some].tolist(), b[some].tolist(), strict=True):
        own = i + np.flatnonzero(member[i:j])
        _, places = np.unique(at[own], return_index=True)
        if len(places) < need:
            continue
        end = int(own[places.max()]) + 1  # the word that completes the share
        if line[i] != line[end - 1]:
            found.append((i, end, len(places) / size))
    out: list[tuple[int, int, float]] = []
    k = 0
    while k < len(found):
        best, reach = found[k], found[k][1]
        while k < len(found) and found[k][0] < reach:
            if found[k][2] > best[2]:
                best = found[k]
            k += 1
        out.append(best)
        while k and found[k - 1][0] >= best[1]:  # windows behind the block are looked at again
            k -= 1
        while k < len(found) and found[k][0] < best[1]:
            k += 1
    return out


def find(data: np.ndarray, off: np.ndarray, vocabulary: Vocabulary, index: Index):
    """(words of each text, phrase places as (text, word, label), blocks as (text, first word, label, share))."""
    w = Words(data, off, ALNUM, lower=True)
    at = vocabulary.ids(w)
    places, blocks = [], []
    for words, label in vocabulary.phrases:
        k = len(words)
        starts = w.windows(k)
        for i, word in enumerate(words):
            starts = starts[at[starts + i] == word]
        places += [(int(w.doc[s]), int(s - w.at[w.doc[s]]), label) for s in starts]
    some = np.flatnonzero(index.prefix[at])
    if len(some):
        starts = np.unique(np.concatenate([off[:-1], np.flatnonzero(data == 10) + 1]))
        line = np.searchsorted(starts, w.start, side="right")
        h, lines = None, []
        for k in np.unique(line[some]).tolist():
            a, b = np.searchsorted(line, k), np.searchsorted(line, k, side="right")
            known = set(at[a:b][at[a:b] >= 0].tolist())
            if len(known) >= min(index.need.values()):
                h = w.hashes() if h is None else h
                for label, share in index.match(known, len(np.unique(h[a:b]))).items():
                    lines.append((int(a), int(b), label, share))
        for label in index.sets:
            if index.first[label][at[some]].any():
                whole = [x for x in lines if x[2] == label]
                for a, b, share in windows(at, w, line, label, vocabulary.span[label], index):
                    if not any(x < b and a < y and share <= most for x, y, _, most in whole):
                        lines.append((a, b, label, share))
        blocks = [(int(w.doc[a]), int(a - w.at[w.doc[a]]), label, share) for a, _, label, share in lines]
    return w.n, places, blocks


SCHEMA = (
    "doc_id long, sig long, n_words long, places array<struct<word:long,label:string>>, "
    "blocks array<struct<word:long,label:string,share:double>>"
)


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, contained: float = CONTAINED) -> DataFrame:
    """Every row's phrase places and template blocks, by start in words, with doc_id and sig."""
    vocabulary = Vocabulary(templates)
    index = Index(vocabulary.sets, frequencies(docs, vocabulary), contained)

    def kernel(batch: pa.RecordBatch):
        for i, j, data, off in passes(batch.column(1)):
            rows = batch.slice(i, j - i)
            n, places, blocks = find(data, off, vocabulary, index)
            own, held = [[] for _ in n], [[] for _ in n]
            for d, word, label in sorted(places):
                own[d].append({"word": word, "label": label})
            for d, word, label, share in sorted(blocks):
                held[d].append({"word": word, "label": label, "share": share})
            yield [rows.column(0), rows.column(2), n, own, held]

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_sig().alias("sig")), kernel, SCHEMA)


def digest(found: DataFrame) -> DataFrame:
    """Counts, labels and score of scan()'s rows: 1 where a phrase stands, else the best share of a template."""
    label = lambda x: x["label"]
    base, more = F.transform("places", label), F.transform("blocks", label)
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(F.transform("places", lambda x: x["word"])).alias("first_word"), F.array_max(F.transform("places", lambda x: x["word"])).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, more)), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("blocks", lambda x: x["share"])), F.lit(0.0))).alias("score"),
    )
