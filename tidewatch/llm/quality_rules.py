"""Operator 3: quality rules by repetition coverage.

Rolling hashes of several n-gram lengths mark the characters that stand in n-grams or lines found
twice or more in their own text; a text fails where the marked share is over the limit of its length.

Defined cases: null, empty and blank texts have no words and fail; a text shorter than an n-gram has
none of that length; every row is judged by itself, so repeated rows and ids change nothing; other
columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import mapped, passes, row_sig
from .words import _BYTES, Words, covered, mix, prefix, repeated, spans_hash, window_hash

#: Words in an n-gram, and the largest share of word characters that repeated ones may cover.
GRAM_LIMITS = {5: 0.40, 6: 0.38, 7: 0.36, 8: 0.34, 9: 0.32, 10: 0.30}
#: The largest share of line characters in lines seen earlier in the text.
LINE_LIMIT = 0.30
MIN_WORDS, WINDOW, MOST_REPEATED = 20, 8, 30
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True

SCHEMA = (
    "doc_id long, sig long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "gram_coverage double, line_coverage double, base_failed boolean, kept boolean"
)


def _sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def duplicate_lines(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By text: lines with a word that equal an earlier line, their code points, and those of all lines with a word."""
    n = len(w.data)
    if not n:
        zero = np.zeros(w.docs, np.int64)
        return zero, zero, zero
    breaks = np.flatnonzero(w.data == 10)
    start = np.unique(np.concatenate([w.off[:-1][w.off[:-1] < n], breaks[breaks + 1 < n] + 1]))
    end = np.append(start[1:], n)
    end = end - (w.data[end - 1] == 10)
    words = np.searchsorted(w.start, end) - np.searchsorted(w.start, start)
    start, end = start[words > 0], end[words > 0]
    doc = np.searchsorted(w.off, start, side="right") - 1
    key = mix(spans_hash(prefix(_BYTES[0][w.data], 0), start, end, 0) + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    again[order[1:]] = key[order[1:]] == key[order[:-1]]
    chars = w.char_prefix[end] - w.char_prefix[start]
    sums = lambda x: np.bincount(doc, weights=x, minlength=w.docs).astype(np.int64)
    return sums(again), sums(chars * again), sums(chars)


def measure(data: np.ndarray, off: np.ndarray) -> list:
    """The measures of several texts, in the order of SCHEMA from n_words on."""
    w = Words(data, off)
    chars, h = w.chars(), w.hashes()
    word_chars = w.per_doc(chars)
    salted = w.doc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    fails = np.zeros(w.docs, bool)
    most = np.zeros(w.docs)
    n_repeat = np.zeros(w.docs, np.int64)
    for k in sorted({*GRAM_LIMITS, WINDOW}):
        starts = w.windows(k)
        again = starts[repeated(mix(window_hash(h, starts, k) + salted[starts]))]
        inside = covered(again, k, len(w))
        if k == WINDOW:
            n_repeat = w.per_doc(inside.astype(np.int64))
        if k in GRAM_LIMITS:
            share = w.per_doc(np.where(inside, chars, 0)) / np.maximum(word_chars, 1)
            most = np.maximum(most, share)
            fails |= share > GRAM_LIMITS[k]
    dup_lines, dup_chars, line_chars = duplicate_lines(w)
    line_share = dup_chars / np.maximum(line_chars, 1)
    base = (w.n < MIN_WORDS) | (100 * n_repeat > MOST_REPEATED * w.n)
    kept = ~(base | fails | (line_share > LINE_LIMIT))
    return [w.n, word_chars, _sums(_SYMBOLS[data], off), dup_lines, n_repeat, most, line_share, base, kept]


def quality_rules(docs: DataFrame) -> DataFrame:
    """Every row's measures and verdict, with doc_id and sig (see shared.row_sig)."""

    def kernel(batch: pa.RecordBatch):
        for i, j, data, off in passes(batch.column(1)):
            rows = batch.slice(i, j - i)
            yield [rows.column(0), rows.column(2), *measure(data, off)]

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_sig().alias("sig")), kernel, SCHEMA)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that pass: one pass over the texts and no shuffle."""
    names = docs.columns
    at = names.index("text")

    def run(batches):
        for batch in batches:
            keep = [measure(data, off)[-1] for _, _, data, off in passes(batch.column(at))]
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(run, docs.schema)
