"""Operator 5: languages of mixed documents by expectation-maximisation.

Learned: for each language, how often each hashed three-byte gram occurs in lower-cased texts with that
label, over all documents that may be learned from. Applied: a document is a mixture of languages, each of
its words drawn from one; expectation-maximisation over the words' n-gram likelihoods estimates the shares.
Languages enter by share as long as the likelihood, penalised by half the logarithm of the words for each
further language, improves; the prediction is the largest share of the selected set.

Defined cases: null texts and texts without a letter are `und` with score 0; nothing learned gives `und`
for all; ties go to the language first by code point; each row is judged by itself, so repeated rows agree;
other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import PASS_BYTES, arrow_schema, as_batch, mapped, passes
from .words import LOWER, Words

#: Buckets of hashed grams, rounds of expectation-maximisation, and the weight of a gram never seen.
BUCKETS, ROUNDS, SMOOTH = 1 << 14, 8, 0.5
#: Grams whose likelihoods are held at a time, and languages beyond which passes over texts are smaller.
SLICE, FEW = 1 << 16, 8
#: Documents with this remainder of crc32(doc_id as text) by FOLDS are never learned from.
FOLDS, HELD_OUT = 4, 2
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def grams(data: np.ndarray) -> np.ndarray:
    """The bucket of the three bytes from each byte on; the last two have none."""
    x = LOWER[data].astype(np.uint32)
    if len(x) < 3:
        return np.zeros(0, np.uint32)
    return (((x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(18)


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages by code point, and the log-probability of each bucket in each (buckets by languages)."""
    arrow = arrow_schema("lang string, bucket int, n long")

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for i, j, data, off in passes(batch.column(0)):
                g = grams(data)
                own = np.repeat(np.arange(j - i), np.diff(off))
                inside = own[:-2] == own[2:] if len(own) > 2 else np.zeros(0, bool)
                names, at = np.unique(langs[i:j].astype(str), return_inverse=True)
                both = np.bincount(at[own[:-2][inside]] * BUCKETS + g[inside], minlength=len(names) * BUCKETS).reshape(len(names), -1)
                for name, row in zip(names.tolist(), both, strict=True):
                    total[name] = total[name] + row if name in total else row
            if len(total) > 64:
                yield from rows(total)
                total = {}
        yield from rows(total)

    def rows(total):
        for name, row in total.items():
            at = np.flatnonzero(row)
            if len(at):
                yield as_batch([[name] * len(at), at, row[at]], arrow)

    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    sums = known.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = sums.toArrow()  # BUCKETS rows a language at most
    if not found.num_rows:
        return [], np.zeros((BUCKETS, 0), np.float32)
    names, at = np.unique(np.array(found["lang"].to_pylist()), return_inverse=True)
    n = np.full((BUCKETS, len(names)), SMOOTH)
    n[found["bucket"].to_numpy(), at] += found["n"].to_numpy()
    return names.tolist(), np.log(n / n.sum(axis=0)).astype(np.float32)


class _Part:
    """The words of some texts: each one's text, and where texts begin."""

    def __init__(self, n: np.ndarray):
        self.n, self.at = n, np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)
        self.doc = np.repeat(np.arange(len(n)), n)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sums of the rows of values by text; texts without words get zeros."""
        out = np.zeros((len(self.n), values.shape[1]))
        full = np.flatnonzero(self.n)
        if len(full):
            out[full] = np.add.reduceat(values, self.at[full], axis=0)
        return out


def _mixture(like: np.ndarray, share: np.ndarray, w: _Part, rounds: int) -> np.ndarray:
    for _ in range(rounds):
        part = like * share[w.doc]
        part /= np.maximum(part.sum(axis=1, keepdims=True), 1e-30)
        share = w.sums(part) / np.maximum(w.n, 1)[:, None]
    return share


def _word_logs(g: np.ndarray, first: np.ndarray, last: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Each word's log-likelihood in each language: sums of the table over its grams, a slice of SLICE grams at a time."""
    out = np.zeros((len(first), table.shape[1]))
    i = 0
    while i < len(first):
        lo = int(first[i])
        if last[i] - lo > SLICE:  # a word as long as a text: its grams are counted, not listed
            out[i] = np.bincount(g[lo : last[i]], minlength=BUCKETS) @ table
            i += 1
            continue
        j = i + int(np.searchsorted(last[i:], lo + SLICE, side="right"))
        total = np.zeros((int(last[j - 1]) - lo + 1, table.shape[1]))
        np.cumsum(table[g[lo : last[j - 1]]], axis=0, out=total[1:])
        out[i:j] = total[last[i:j] - lo] - total[first[i:j] - lo]
        i = j
    return out


def infer(data: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For several texts: each language's share (zero outside the selected set), and the selected set's penalised likelihood.

    Sets grow by one language at a time, each text's until it gains nothing.
    """
    w, k = Words(data, off), table.shape[1]
    g = grams(data)
    # A word's grams start at the separator before it, where there is one, and end within a byte after it.
    first = np.minimum(np.maximum(w.start - 1, off[w.doc]), len(g)) if len(w) else w.start
    last = np.clip(np.minimum(w.end - 1, off[w.doc + 1] - 2), first, len(g)) if len(w) else w.end
    like = _word_logs(g, first, last, table)
    if len(w):
        like = np.exp(np.maximum(like - like.max(axis=1, keepdims=True), -60))
    part, still = _Part(w.n), np.arange(w.docs)
    share = _mixture(like, np.full((w.docs, k), 1 / k), part, ROUNDS)
    rank = np.argsort(np.argsort(-share, axis=1, kind="stable"), axis=1, kind="stable")
    best, chosen = np.full(w.docs, -np.inf), np.zeros((w.docs, k))
    for size in range(1, k + 1):
        within = rank[still] < size
        trial = np.where(within, share[still] + 1e-9, 0)
        trial = _mixture(like, trial / trial.sum(axis=1, keepdims=True), part, 2 if size > 1 else 0)
        fit = np.log(np.maximum((like * trial[part.doc]).sum(axis=1, keepdims=True), 1e-30))
        score = part.sums(fit)[:, 0] - (size - 1) / 2 * np.log(np.maximum(part.n, 2))
        better = score > best[still]
        best[still[better]], chosen[still[better]] = score[better], trial[better]
        like, still = like[better[part.doc]], still[better]
        if not len(still):
            break
        part = _Part(w.n[still])
    return chosen, best


def letters(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Which texts have a letter."""
    n = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_ASCII_LETTER[data], out=n[1:])
    has = n[off[1:]] > n[off[:-1]]
    for d in np.flatnonzero(~has & (np.diff(off) > 0)).tolist():
        has[d] = any(map(str.isalpha, data[off[d] : off[d + 1]].tobytes().decode()))
    return has


def predict(docs: DataFrame, names: list[str], table: np.ndarray) -> DataFrame:
    """Every row's doc_id, held_out, lang_pred, score, and all shares of the selected set by language."""
    schema = "doc_id long, held_out boolean, lang_pred string, score double, shares map<string,double>"
    model = docs.sparkSession.sparkContext.broadcast(table)  # BUCKETS values a language
    labels = np.array([*names, "und"], object)

    def kernel(batch: pa.RecordBatch):
        for i, j, data, off in passes(batch.column(1), PASS_BYTES * FEW // max(FEW, len(names))):
            rows, has = batch.slice(i, j - i), letters(data, off)
            if names:
                share, _ = infer(data, off, model.value)
                at = np.where(has, share.argmax(axis=1), len(names))
                score = np.where(has, np.clip(share.max(axis=1), 0, 1), 0.0)
                maps = [[(names[c], float(row[c])) for c in np.flatnonzero(row > 0).tolist()] if h else [] for row, h in zip(share, has.tolist(), strict=True)]
            else:
                at, score, maps = np.zeros(j - i, np.int64), np.zeros(j - i), [[]] * (j - i)
            yield [rows.column(0), rows.column(2), pa.array(labels[at], pa.string()), score, maps]

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out().alias("held_out")), kernel, schema)


def identify(docs: DataFrame) -> DataFrame:
    """predict() by what the documents outside the held-out fold teach."""
    names, table = learn(docs.where(~held_out()))
    return predict(docs, names, table)
