"""Operator 11: periodic runs of words, by the runs theorem.

Every maximal run has, under one of two opposite orders of words, a Lyndon root that is the longest Lyndon
word at its place. The longest Lyndon word at a place ends where the next smaller suffix starts, so both are
read from the inverse suffix array by next-smaller (next-greater) values; each root is extended to both sides by
common extensions, which are range minima over the LCP arrays of the words and of the words reversed. All texts of a
pass are worked on at once in numpy: prefix doubling sorts only the suffixes that are still tied, range minima are
sparse tables. A text of n words takes O(n log n) time and about 12 n log2(n) bytes at the most; texts without long repeats far less.

Defined cases: null, empty and blank texts have no words, no run and an empty collapsed text; words are compared exactly, by a
dictionary of the pass; every row is judged by itself, so repeated rows and ids change nothing; runs may overlap, each is
reported; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import mapped, passes, row_sig
from .words import Words, gathered

#: The least number of words in a run.
LEAST = 12

SCHEMA = "doc_id long, sig long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def word_ids(w: Words) -> np.ndarray:
    """A number for each word, the same for equal words only."""
    if not len(w):
        return np.zeros(0, np.int64)
    lengths = w.end - w.start
    off = np.zeros(len(w) + 1, np.int64)
    np.cumsum(lengths, out=off[1:])
    column = pa.Array.from_buffers(pa.large_binary(), len(w), [None, pa.py_buffer(off), pa.py_buffer(gathered(w.data, w.start, lengths))])
    return column.dictionary_encode().indices.to_numpy().astype(np.int64)


def minima(values: np.ndarray) -> list[np.ndarray]:
    """Sparse table: entry k holds the least of the 2**k values from each place on."""
    table = [values]
    while 2 << (len(table) - 1) <= len(values):
        half, last = 1 << (len(table) - 1), table[-1]
        table.append(np.minimum(last[:-half], last[half:]))
    return table


class Suffixes:
    """Sorted suffixes of texts laid one behind another, each closed by a mark that is smaller than any word of it.

    rank is the inverse suffix array; a text's suffixes are neighbours in the order.
    """

    def __init__(self, key: np.ndarray):
        order = np.argsort(key, kind="stable")
        self.rank = self._heads(key[order], order, np.arange(len(key)), np.empty(len(key), np.int32))
        self.levels = [self.rank]
        todo, step = self._tied(order), 1
        while len(todo):
            a, b = self.rank[todo].astype(np.int64), self.rank[todo + step].astype(np.int64)
            at = np.argsort(a * (len(key) + 1) + b, kind="stable")
            a, b, todo = a[at], b[at], todo[at]
            begins = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
            slot = a + np.arange(len(a)) - np.repeat(begins, np.diff(np.append(begins, len(a))))
            self.rank = self._heads(a * (len(key) + 1) + b, todo, slot, self.rank.copy())
            self.levels.append(self.rank)
            todo, step = self._tied(todo), step * 2
        place = np.empty(len(key), np.int64)
        place[self.rank] = np.arange(len(key))
        #: lcp[i]: words that the suffixes of ranks i - 1 and i have in common.
        self.lcp = np.zeros(len(key), np.int32)
        same = np.flatnonzero(self.levels[0][place[:-1]] == self.levels[0][place[1:]])
        self.lcp[same + 1] = self._by_levels(place[same], place[same + 1])
        self.levels = None
        self.table = minima(self.lcp)

    @staticmethod
    def _heads(key, where, slot, rank):
        """Gives each entry of an ordered key the slot at which its equals begin."""
        head = np.where(np.append(True, key[1:] != key[:-1]), slot, 0)
        rank[where] = np.maximum.accumulate(head)
        return rank

    def _tied(self, where):
        r = self.rank[where]
        same = r[1:] == r[:-1]
        return where[np.append(same, False) | np.append(False, same)]

    def _by_levels(self, i, j):
        """Common words of suffixes, from the ranks by 2**k words."""
        out = np.zeros(len(i), np.int64)
        for k in reversed(range(len(self.levels))):
            level = self.levels[k]
            out += (level[i + out] == level[j + out]).astype(np.int64) << k
        return out

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common words of the suffixes at i and at j, which differ, by range minimum."""
        a, b = self.rank[i].astype(np.int64), self.rank[j].astype(np.int64)
        low, high = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        k = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(i), np.int64)
        for level in np.unique(k).tolist():
            own = np.flatnonzero(k == level)
            row = self.table[level]
            out[own] = np.minimum(row[low[own]], row[high[own] - (1 << level)])
        return out


def next_smaller(values: np.ndarray) -> np.ndarray:
    """The next place with a smaller value, or the number of values, by growing and then halving steps in a sparse table."""
    table, n = minima(values), len(values)
    at = np.arange(1, n + 1)

    def step(own, k):
        """Those of own whose next 2**k values are all larger, moved behind them."""
        own = own[at[own] < len(table[k])]
        own = own[table[k][at[own]] > values[own]]
        at[own] += 1 << k
        return own

    ways, own = [], np.arange(n)
    for k in range(len(table)):
        own = step(own, k)
        ways.append(own)
    for k in reversed(range(len(ways))):  # who made a step of 2**k stopped at a larger one
        step(ways[k], k)
    return at


def runs(ids: np.ndarray, first: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All maximal runs of texts, whose words are ids[first[d]:first[d + 1]]: text, start in it, length, period; by text, start, period."""
    n, docs = np.diff(first), len(first) - 1
    none = (np.zeros(0, np.int64),) * 4
    if not len(ids):
        return none
    base = first[:-1] + np.arange(docs)  # where a text begins when each is followed by its mark
    doc = np.repeat(np.arange(docs), n + 1)
    mark = base + n
    is_word = np.ones(len(ids) + docs, bool)
    is_word[mark] = False
    value = np.zeros(len(doc), np.int64)
    value[is_word] = ids + 1
    width = int(ids.max()) + 2
    turned = np.arange(len(doc))
    turned[is_word] = (2 * base[doc] + n[doc] - 1 - turned)[is_word]
    ahead, back = Suffixes(doc * width + value), Suffixes(doc * width + value[turned])
    rank = ahead.rank.astype(np.int64)
    place = np.flatnonzero(is_word)
    starts, periods = [], []
    for greater in (False, True):
        order = np.where(is_word, -rank, -len(rank)) if greater else rank
        end = next_smaller(order)[place]
        ok = end < mark[doc[place]] if greater else end <= mark[doc[place]]  # the mark is the largest in the opposite order
        starts.append(place[ok]), periods.append(end[ok] - place[ok])
    at, p = np.concatenate(starts), np.concatenate(periods)
    fits = 2 * p <= n[doc[at]]
    at, p = at[fits], p[fits]
    d = doc[at]
    left, right = np.zeros((2, len(at)), np.int64)
    same = np.flatnonzero(value[at] == value[at + p])
    right[same] = ahead.common(at[same], (at + p)[same])
    inner = (at > base[d]) & (right + (at - base[d]) >= p)  # others can't reach two periods
    inner = np.flatnonzero(inner & (value[at - 1] == value[at + p - 1]))
    mirror = lambda x: 2 * base[d[inner]] + n[d[inner]] - 1 - x[inner]
    left[inner] = back.common(mirror(at - 1), mirror(at + p - 1))
    length = left + p + right
    good = (length >= 2 * p) & (length >= least)
    start, p, length, d = (at - left)[good], p[good], length[good], d[good]
    _, one = np.unique(start * (len(doc) + 1) + p, return_index=True)
    return d[one], (start - base[d])[one], length[one], p[one]


def collapse(w: Words, found) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts' kept words, joined by one space: those that no run covers beyond its first period."""
    d, start, length, p = found
    begin = w.at[d] + start
    step = np.bincount(begin + p, minlength=len(w) + 1) - np.bincount(begin + length, minlength=len(w) + 1)
    keep = np.flatnonzero(np.cumsum(step)[: len(w)] == 0)
    doc = w.doc[keep]
    lengths = w.end[keep] - w.start[keep] + 1  # with the space before it
    lengths[np.append(True, doc[1:] != doc[:-1])[: len(doc)]] -= 1
    ends = np.cumsum(lengths)
    out = np.full(int(ends[-1]) if len(ends) else 0, 32, np.uint8)
    own = w.end[keep] - w.start[keep]
    at = np.repeat(ends - own - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))
    out[at] = gathered(w.data, w.start[keep], own)
    off = np.zeros(w.docs + 1, np.int64)
    np.cumsum(np.bincount(doc, weights=lengths, minlength=w.docs).astype(np.int64), out=off[1:])
    return out, off


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Every row's doc_id, sig, number of words, runs of at least so many words (by start, then period) and collapsed text."""

    def kernel(batch: pa.RecordBatch):
        for i, j, data, off in passes(batch.column(1)):
            w = Words(data, off)
            found = runs(word_ids(w), w.at, least)
            text, at = collapse(w, found)
            bounds = np.zeros(w.docs + 1, np.int32)
            np.cumsum(np.bincount(found[0], minlength=w.docs), out=bounds[1:])
            spans = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in found[1:]], ["start", "length", "period"])
            collapsed = pa.Array.from_buffers(pa.large_string(), w.docs, [None, pa.py_buffer(at), pa.py_buffer(text)])
            rows = batch.slice(i, j - i)
            yield [rows.column(0), rows.column(2), w.n, pa.ListArray.from_arrays(pa.array(bounds), spans), collapsed]

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_sig().alias("sig")), kernel, SCHEMA)


def planted(docs: DataFrame) -> DataFrame:
    """docs with the repeats of the query's contract written into a tenth of the texts: from word a on, the p words there over and over.

    Which ones, a and p follow from the CRC-32 of the decimal doc_id; rows without a doc_id stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10).cast("long")
    words = F.regexp_extract_all(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    rows = docs.select(*docs.columns, F.when(h % 10 == 0, words).alias("__w"), g.alias("__g"))
    n = F.size("__w")
    a = (F.col("__g") % n).cast("int")
    rows = rows.withColumn("__a", F.when(n > 0, a))
    rest: Column = n - F.col("__a")
    rows = rows.withColumn("__p", (1 + F.floor(rest / (3 + F.col("__g") % 8))).cast("int"))
    times = F.ceil(rest / F.col("__p")).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("__w", F.col("__a") + 1, F.col("__p")), times)), F.lit(1), rest)
    text = F.array_join(F.concat(F.slice("__w", F.lit(1), F.col("__a")), tail), " ")
    return rows.withColumn("text", F.when(F.col("__a").isNotNull(), text).otherwise(F.col("text"))).select(*docs.columns)


def digest(found: DataFrame) -> DataFrame:
    """The measures of the runs: their number, the longest (ties: smallest start, then period), and hashes of all runs and the text."""
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    rows = found.withColumn("best", best)
    length = -F.col("best.less")
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        length.alias("length"),
        F.col("best.period").alias("period"),
        F.floor(length * 1000 / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
