"""Operator 10: exact substring dedup behind a count-min prefilter.

Every window of 20 words is represented in the sketch by an anchor, the smallest hashed 8-word gram that
it holds (leftmost on ties): equal windows at two places have equal anchors at two places, so an anchor's
count is never below its windows' and the sketch needs one entry per anchor place, about a seventh of the
windows. First pass: every partition counts its anchors in sparse sketch cells; the cells are merged by
block, and those that reach two make a bitmap. Second pass: only windows whose anchor is at two or more
in every sketch row are grouped exactly, by 96 bits of hash; each partition first settles repeats of its
own, so that a passage in a third of all documents sends one window a partition. The sketch is sized from
the bytes of text up to a bound; beyond it more windows pass to the exact grouping, and none is lost.

Defined cases: null has no words; texts with fewer words than a window lose none; a null doc_id orders
last; of rows that repeat one doc_id, windows at the same start do not count as earlier than each other;
other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow_schema, as_batch, passes, row_key, row_sig
from .words import Words, mix, window_hash

WINDOW, ANCHOR = 20, 8
#: Sketch rows; bits that number a block's cells; the fewest bits that number a row's cells.
ROWS, BLOCK_BITS, LEAST_BITS = 2, 18, 20
#: Bits that number the cells of a bitmap of repeated cells, at most (two bitmaps of 64 MB), and the sketch's bits beyond it.
MOST_BITS, BEYOND = 29, 6
#: Bytes of text for one sketch cell: about an eighth of an anchor.
BYTES_A_CELL = 6
#: Anchors or flagged windows that a task gathers before it passes them on.
FLUSH = 1 << 20
#: Bytes of text for one shard of the exact grouping, and the fewest shards.
SHARD_BYTES, LEAST_SHARDS = 64 << 20, 64
_LAST = np.iinfo(np.int64).max


def anchors(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows, the hash of each one's anchor, and the anchor's place."""
    starts = w.windows(WINDOW)
    if not len(starts):
        return starts, np.zeros(0, np.uint64), starts
    h = w.hashes()
    grams = window_hash(h, np.arange(len(w) - ANCHOR + 1), ANCHOR)
    m = len(w) - WINDOW + 1
    best, at = grams[:m].copy(), np.zeros(m, np.int64)
    for i in range(1, WINDOW - ANCHOR + 1):
        less = grams[i : i + m] < best
        best[less] = grams[i : i + m][less]
        at[less] = i
    return starts, mix(best[starts] + np.uint64(1)), starts + at[starts]


def cells(key: np.ndarray, row: int, bits: int) -> np.ndarray:
    """The cell of each key in a sketch row: its upper or its lower bits."""
    part = key >> np.uint64(64 - bits) if row == 0 else key & np.uint64((1 << bits) - 1)
    return part.astype(np.int64)


def _gathered(batches, arrow, take, flush):
    """Feeds texts to take(), which returns how much it holds, and yields what flush() makes of that from time to time."""
    held = 0
    for batch in batches:
        for i, j, data, off in passes(batch.column(1)):
            held += take(batch.slice(i, j - i), Words(data, off))
            if held >= FLUSH:
                for cols in flush():
                    yield as_batch(cols, arrow)
                held = 0
    for cols in flush():
        yield as_batch(cols, arrow)


class Layout:
    """How many cells a sketch row has, and how its repeated cells fold into a bitmap: block by block, one over another."""

    def __init__(self, size: int, most: int = MOST_BITS, block: int = BLOCK_BITS):
        self.bits = min(most + BEYOND, max(LEAST_BITS, (size // BYTES_A_CELL).bit_length()))
        self.folded, self.block = min(most, self.bits - 2), block
        self.over = 1 << (self.bits - self.folded)

    def place(self, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(block of the bitmap, cell within the blocks that fold into it)."""
        block = (cell >> self.block) & ((1 << (self.folded - self.block)) - 1)
        return block, (cell >> self.folded << self.block) | (cell & ((1 << self.block) - 1))


def sketch(rows: DataFrame, layout: Layout) -> list[np.ndarray]:
    """For each sketch row, the bitmap of cells that count two or more over all rows."""
    schema = "sketch_row int, block long, once binary, twice binary"
    arrow = arrow_schema(schema)

    def count(batches):
        keys: list[np.ndarray] = []

        def take(batch, w):
            _, key, place = anchors(w)
            if len(key):
                keys.append(key[np.append(True, place[1:] != place[:-1])])
            return len(keys[-1]) if len(key) else 0

        def flush():
            if not keys:
                return
            all_keys = np.concatenate(keys)
            keys.clear()
            for row in range(ROWS):
                block, within = layout.place(cells(all_keys, row, layout.bits))
                both, n = np.unique(block << 32 | within, return_counts=True)
                block, within = both >> 32, (both & 0xFFFFFFFF).astype(np.uint32)
                for a, b in _pieces(block):
                    own, many = within[a:b], n[a:b] > 1
                    yield [[row], [int(block[a])], [own[~many].tobytes()], [own[many].tobytes()]]

        yield from _gathered(batches, arrow, take, flush)

    def merge(key, batches):
        total = np.zeros(layout.over << layout.block, np.uint8)
        for batch in batches:
            for once, twice in zip(batch.column("once"), batch.column("twice"), strict=True):
                at = np.frombuffer(once.as_buffer(), np.uint32)
                total[at] = np.minimum(total[at] + 1, 2)
                total[np.frombuffer(twice.as_buffer(), np.uint32)] = 2
        hot = (total > 1).reshape(layout.over, -1).any(axis=0)
        yield pa.RecordBatch.from_pydict({"sketch_row": pa.array([key[0].as_py()], pa.int32()), "block": [key[1].as_py()], "hot": [np.packbits(hot, bitorder="little").tobytes()]})

    made = rows.mapInArrow(count, schema).groupBy("sketch_row", "block").applyInArrow(_iterated(merge), "sketch_row int, block long, hot binary")
    out = [np.zeros(1 << (layout.folded - 3), np.uint8) for _ in range(ROWS)]
    size = 1 << (layout.block - 3)
    for row in made.collect():  # bounded: ROWS bitmaps of 2**MOST_BITS bits
        out[row.sketch_row][row.block * size : (row.block + 1) * size] = np.frombuffer(row.hot, np.uint8)
    return out


def _iterated(f):
    """f with the signature that asks for batches of a group instead of its whole table."""
    from collections.abc import Iterator

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(key, batches)

    run.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return run


_WINDOW = np.dtype([("h", np.uint64), ("g", np.uint32), ("doc", np.int64), ("sig", np.int64), ("start", np.int32)])
_SENT = np.dtype([("h", np.uint64), ("g", np.uint32), ("row", np.uint32), ("start", np.int32)])
_ROW = np.dtype([("doc", np.int64), ("sig", np.int64)])
_MOVED = "shard long, doc long, sig long, rows binary, windows binary"


def _later(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, later): windows in order of content, document and start, and which of these start after the first of their content."""
    order = np.lexsort((x["start"], x["doc"], x["g"], x["h"]))
    s = x[order]
    same = np.append(False, (s["h"][1:] == s["h"][:-1]) & (s["g"][1:] == s["g"][:-1]))
    first = np.maximum.accumulate(np.where(same, 0, np.arange(len(s))))
    return order, same & ((s["doc"] != s["doc"][first]) | (s["start"] != s["start"][first]))


def _by_row(x: np.ndarray):
    """(doc, sig, bytes of the starts) of the windows of each row."""
    x = x[np.lexsort((x["start"], x["sig"], x["doc"]))]
    for a, b in _pieces(x[["doc", "sig"]]):
        yield int(x["doc"][a]), int(x["sig"][a]), x["start"][a:b].tobytes()


def repeats(rows: DataFrame, hot: list[np.ndarray], layout: Layout, shards: int) -> DataFrame:
    """(doc, sig, starts) of windows that start later than their first occurrence; a row may come in several parts."""
    arrow = arrow_schema(_MOVED)
    marks = rows.sparkSession.sparkContext.broadcast(hot)

    def second(batches):
        held: list[np.ndarray] = []

        def take(batch, w):
            starts, key, _ = anchors(w)
            for row in range(ROWS):
                cell = cells(key, row, layout.bits) & ((1 << layout.folded) - 1)
                hit = (marks.value[row][cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 > 0
                starts, key = starts[hit], key[hit]
            if len(starts):
                x = np.zeros(len(starts), _WINDOW)
                x["h"] = window_hash(w.hashes(0), starts, WINDOW)
                x["g"] = window_hash(w.hashes(1), starts, WINDOW, 3) >> np.uint64(32)
                doc = batch.column(0).fill_null(_LAST).to_numpy(zero_copy_only=False)
                x["doc"], x["sig"] = doc[w.doc[starts]], batch.column(2).to_numpy()[w.doc[starts]]
                x["start"] = starts - w.at[w.doc[starts]]
                held.append(x)
            return len(starts)

        def flush():
            if not held:
                return
            x = np.concatenate(held)
            held.clear()
            order, later = _later(x)
            local = list(_by_row(x[order[later]]))
            if local:
                docs, sigs, starts = zip(*local, strict=True)
                yield [[(d ^ s) % shards for d, s in zip(docs, sigs, strict=True)], docs, sigs, [None] * len(docs), starts]
            x = x[order[~later]]  # in order of h, and so of shard
            to = (x["h"] >> np.uint64(40)).astype(np.int64) * shards >> 24
            for a, b in _pieces(to):
                rows_of, at = np.unique(x[["doc", "sig"]][a:b].astype(_ROW), return_inverse=True)
                sent = np.zeros(b - a, _SENT)
                sent["h"], sent["g"], sent["row"], sent["start"] = x["h"][a:b], x["g"][a:b], at, x["start"][a:b]
                yield [[int(to[a])], [None], [None], [rows_of.tobytes()], [sent.tobytes()]]

        yield from _gathered(batches, arrow, take, flush)

    def settle(t: pa.Table) -> pa.Table:
        parts, docs, sigs, starts = [], [], [], []
        for doc, sig, rows_of, windows in zip(t["doc"].to_pylist(), t["sig"].to_pylist(), t["rows"], t["windows"], strict=True):
            if doc is not None:
                docs.append(doc), sigs.append(sig), starts.append(windows.as_py())
                continue
            sent, of = np.frombuffer(windows.as_buffer(), _SENT), np.frombuffer(rows_of.as_buffer(), _ROW)
            x = np.zeros(len(sent), _WINDOW)
            x["h"], x["g"], x["start"] = sent["h"], sent["g"], sent["start"]
            x["doc"], x["sig"] = of["doc"][sent["row"]], of["sig"][sent["row"]]
            parts.append(x)
        if parts:
            x = np.concatenate(parts)
            order, later = _later(x)
            for doc, sig, own in _by_row(x[order[later]]):
                docs.append(doc), sigs.append(sig), starts.append(own)
        return pa.table({"doc": pa.array(docs, pa.int64()), "sig": pa.array(sigs, pa.int64()), "starts": pa.array(starts, pa.binary())})

    return rows.mapInArrow(second, _MOVED).groupBy("shard").applyInArrow(settle, "doc long, sig long, starts binary")


def _pieces(values: np.ndarray):
    """(first, after the last) of the stretches of equal values."""
    edge = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
    return zip(edge, np.append(edge[1:], len(values))[: len(edge)], strict=True)


def substring_dedup(docs: DataFrame, most_bits: int = MOST_BITS, block_bits: int = BLOCK_BITS) -> DataFrame:
    """Every row's doc_id, sig, n_words, n_removed, the kept words as kept_text, and its SHA-256."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_sig().alias("sig"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    layout = Layout(size, most_bits, block_bits)
    hot = sketch(rows, layout)
    found = repeats(rows, hot, layout, max(LEAST_SHARDS, -(-size // SHARD_BYTES)))
    found = found.withColumn("doc_id", F.when(F.col("doc") != _LAST, F.col("doc")))
    found = found.groupBy(row_key(F.col("sig")).alias("key")).agg(F.collect_list("starts").alias("starts"))
    both = rows.withColumn("key", row_key(F.col("sig"))).join(found, "key", "left").select("doc_id", "text", "sig", "starts")
    schema = "doc_id long, sig long, n_words long, n_removed long, kept_text string, kept_sha256 string"
    arrow = arrow_schema(schema)

    def strip(batches):
        for batch in batches:
            counts, removed, texts, sums = [], [], [], []
            for text, starts in zip(batch.column(1), batch.column(3), strict=True):
                words = text.as_buffer().to_pybytes().split() if text.is_valid else []
                n = len(words)
                counts.append(n)
                if starts.is_valid:
                    at = np.frombuffer(b"".join(starts.as_py()), np.int32)
                    step = np.bincount(at, minlength=n + 1) - np.bincount(at + WINDOW, minlength=n + 1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(step)[:n] == 0).tolist()]
                removed.append(n - len(words))
                line = b" ".join(words)
                texts.append(line.decode())
                sums.append(hashlib.sha256(line).hexdigest())
            yield as_batch([batch.column(0), batch.column(2), counts, removed, texts, sums], arrow)

    return both.mapInArrow(strip, schema)
