"""The pipeline's near-duplicate stage: SimHash fingerprints in vantage-point trees, checked exactly, and what lies beyond their radius.

Texts are alike whose sets of shingles have a Jaccard similarity of LEAST or more. First each set has its SimHash fingerprint, and
operator 2's trees link fingerprints of RADIUS bits or fewer; the sets that these links connect are a bucket. At similarity 0.8
about 10 bits differ, and at a radius that holds such pairs a tree prunes nothing. So what is still apart is looked for by
min-hashes, too. A set's sketch has one byte for each of SKETCH hash functions, that of its smallest shingle; two sets agree
in a byte about as often as they are alike. Sets that agree in all ROWS bytes of one of BANDS bands are a bucket.

Sets of a bucket are compared: sizes, then the agreement of sketches, then the sets on their texts. At the similarity itself
a pair is in no common band with a probability of 5e-6, and agrees in fewer than AGREE bytes with one of 7e-6; both fall fast
above it. Nothing is dropped otherwise.

Of the sets in a bucket all are compared with one first, the one that meets most others over all its buckets; what links
connect needs no more comparisons. Buckets that are still apart compare their smaller parts with all, in cells of
bounded size, and only the pairs that pass the sketches leave a cell. This is quadratic in the sets of a bucket
that are neither alike nor far apart.

Defined cases: words are as in operator 2; null and blank texts are alike; fewer words than a shingle are one shingle;
repeated rows and texts of equal sets are one set; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.dedup import components as connected

from . import simhash
from .shared import arrow_schema, as_batch, cut, mapped, passes, row_key, row_sig, utf8
from .words import U, Words, among, mix, prefix, spans_hash, window_hash

WIDTH, LEAST = 5, 0.8
#: Bits in which fingerprints that the trees link differ, at most.
RADIUS = simhash.RADIUS
#: Bands and bytes in each, all bytes of a sketch, and the fewest that two sets of LEAST agree in.
BANDS, ROWS, SKETCH, AGREE = 40, 6, 480, 347
#: The lowest bits of a bucket's key name its band, or the trees.
TREES = 63
#: Texts of candidate pairs whose keys are sent to all workers to pick them out, at most; beyond, they are joined.
BROADCAST = 2_000_000
#: Sets of a bucket in one part; cells compare two parts.
PART = 4_096
#: Text bytes of pairs that are compared at a time.
PAIR_BYTES = 1 << 21

_rng = np.random.Generator(np.random.PCG64(20240505))
_MUL = _rng.integers(0, 2**31, SKETCH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(0, 2**32, SKETCH, dtype=np.uint32)


def shingles(data: np.ndarray, off: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles of texts, by text and hash."""
    w = Words(data, off, lower=True)
    h = w.hashes()
    starts = w.windows(width)
    short = np.flatnonzero((w.n > 0) & (w.n < width))
    key, doc = window_hash(h, starts, width), w.doc[starts]
    if len(short):
        key = np.concatenate([key, spans_hash(prefix(h, 2), w.at[short], w.at[short + 1], 2)])
        doc = np.concatenate([doc, short])
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], key[new]


def set_ids(doc: np.ndarray, key: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, size) of each text's set."""
    at = np.searchsorted(doc, np.arange(docs + 1))
    total = np.zeros(len(key) + 1, U)
    np.cumsum(mix(key ^ U(0x5851F42D4C957F2D)), out=total[1:])
    n = np.diff(at)
    return mix(total[at[1:]] - total[at[:-1]] + mix(n.astype(U) + U(1))), n


def sketches(doc: np.ndarray, key: np.ndarray, docs: int) -> np.ndarray:
    """The sketch of each text's set (docs by SKETCH); empty sets have zeros."""
    at = np.searchsorted(doc, np.arange(docs + 1))
    full = np.flatnonzero(np.diff(at))
    out = np.zeros((docs, SKETCH), np.uint8)
    if len(full):
        x, starts = (key >> U(32)).astype(np.uint32), at[full]
        for k in range(SKETCH):
            least = np.minimum.reduceat(x * _MUL[k] + _ADD[k], starts)
            out[full, k] = (least * np.uint32(0x9E3779B1)) >> np.uint32(24)
    return out


def needed(n: np.ndarray, least: float) -> np.ndarray:
    """How many shingles of n another set must have at least, to be as similar."""
    return np.ceil(least * n - 1e-9).astype(np.int64)


def described(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, sig, id, n, fp, sketch) of every row: its set's hash, size, fingerprint and sketch; a task gives the last two of a set once."""
    schema = "doc_id long, sig long, id long, n long, fp long, sketch binary"
    arrow = arrow_schema(schema)

    def run(batches):
        seen: set = set()
        for batch in batches:
            for i, j, data, off in passes(batch.column(1)):
                doc, key = shingles(data, off, width)
                ids, n = set_ids(doc, key, j - i)
                new = np.zeros(j - i, bool)
                for k, x in enumerate(ids.tolist()):
                    if x not in seen:
                        seen.add(x)
                        new[k] = True
                keep = new[doc]
                of = (np.cumsum(new) - 1)[doc[keep]]
                bytes_of = sketches(of, key[keep], int(new.sum()))
                fp = np.zeros(j - i, np.uint64)
                fp[new] = simhash.majority(of, mix(key[keep]), n[new])
                held: list[bytes | None] = [None] * (j - i)
                for k, row in zip(np.flatnonzero(new).tolist(), bytes_of, strict=True):
                    held[k] = row.tobytes()
                rows = batch.slice(i, j - i)
                yield as_batch([rows.column(0), rows.column(2), ids.view(np.int64), n, pa.array(fp.view(np.int64), mask=~new), held], arrow)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_sig().alias("sig")).mapInArrow(run, schema)


def shared(rows: DataFrame) -> DataFrame:
    """(key, id) of the rows (key, id) whose key several ids have, each once."""
    schema = "key long, id long"
    arrow = arrow_schema(schema)

    def run(batches):
        held = np.zeros((2, 0), np.int64)
        shared = None  # the last key, if it has been given out
        for batch in batches:
            now = np.concatenate([held, np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])], axis=1)
            new = np.ones(now.shape[1], bool)
            new[1:] = (now[:, 1:] != now[:, :-1]).any(axis=0)
            now = now[:, new]
            key = now[0]
            several = np.zeros(len(key), bool)
            several[1:] |= key[1:] == key[:-1]
            several[:-1] |= key[1:] == key[:-1]
            if shared is not None:
                several |= key == shared
            held = now[:, -1:]
            if several[:-1].any():
                yield as_batch([*now[:, :-1][:, several[:-1]]], arrow)
            shared = key[-1] if len(key) and several[-1] else None
        if shared is not None:
            yield as_batch([*held], arrow)

    return rows.repartition("key").sortWithinPartitions("key", "id").mapInArrow(run, schema)


def tree_buckets(sets: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(key, id) of sets whose fingerprints are linked within the radius, directly or through others, each once; sets may be repeated."""
    sets = sets.where("n > 0")
    edges = cut(simhash.shard_edges(cut(sets.select("fp").distinct()), radius))  # else a task would hold a Python worker for the trees and one for the forest
    roots = connected(edges, checkpoint=cut)
    placed = sets.select("fp", "id").join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    return shared(placed.select(_key(F.xxhash64(F.coalesce("root", "fp")), TREES), "id"))


def band_buckets(sets: DataFrame) -> DataFrame:
    """(key, id) of the sets that have a band in common with another, each once; sets may be repeated."""
    band = lambda k: _key(F.xxhash64(k, F.substring("sketch", k * ROWS + 1, F.lit(ROWS))), k)
    return shared(sets.where("n > 0").select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), band)).alias("key"), "id"))


def _key(bits: Column, name: Column | int) -> Column:
    """A bucket's key: bits, of which the lowest name the band."""
    name = F.lit(name) if isinstance(name, int) else name
    return bits.bitwiseAND(F.lit(-64)).bitwiseOR(name.cast("long")).alias("key")


def _square(column: pa.Array) -> np.ndarray:
    """The sketches of a column as rows of bytes."""
    return utf8(column)[0].reshape(-1, SKETCH)


def likely(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(a, b, sig_a, sig_b) of the pairs (a, b) whose sizes and sketches allow the similarity."""

    def kernel(batch: pa.RecordBatch):
        same = (_square(batch.column(4)) == _square(batch.column(5))).sum(axis=1)
        yield [c.filter(pa.array(same >= AGREE)) for c in batch.columns[:4]]

    of = lambda c: sets.select(F.col("id").alias(c), *[F.col(k).alias(f"{k}_{c}") for k in ("n", "sig", "sketch")])
    near = F.least("n_a", "n_b") >= F.ceil(F.greatest("n_a", "n_b") * least - 1e-9)
    rows = pairs.join(of("a"), "a").join(of("b"), "b").where(near).select("a", "b", "sig_a", "sig_b", "sketch_a", "sketch_b")
    return mapped(rows, kernel, "a long, b long, sig_a long, sig_b long")


def alike(docs: DataFrame, pairs: DataFrame, width: int, least: float) -> DataFrame:
    """(a, b) of the pairs of likely() whose sets have the similarity, by their texts."""
    pairs = cut(pairs)
    wanted = cut(pairs.select(F.col("sig_a").alias("sig")).union(pairs.select("sig_b")).distinct())
    texts = docs.select(row_sig().alias("sig"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.join(F.broadcast(wanted) if wanted.count() <= BROADCAST else wanted, "sig", "left_semi").dropDuplicates(["sig"])

    def kernel(batch: pa.RecordBatch):
        keep = np.zeros(batch.num_rows, bool)
        sizes = [np.diff(utf8(batch.column(c))[1]) for c in (2, 3)]
        done = np.cumsum(sizes[0] + sizes[1])
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(done, done[i] + PAIR_BYTES)))
            part = batch.slice(i, j - i)
            sets = []
            for c in (2, 3):
                doc, key = shingles(*utf8(part.column(c)), width)
                sets.append(np.split(key, np.searchsorted(doc, np.arange(1, part.num_rows))))
            for k, (x, y) in enumerate(zip(*sets, strict=True)):
                both = int(among(x, y).sum())
                keep[i + k] = both >= math.ceil(least * (len(x) + len(y) - both) - 1e-9)
            i = j
        yield [batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))]

    of = lambda c: texts.select(F.col("sig").alias(f"sig_{c}"), F.col("text").alias(f"text_{c}"))
    rows = pairs.join(of("a"), "sig_a").join(of("b"), "sig_b").select("a", "b", "text_a", "text_b")
    return mapped(rows, kernel, "a long, b long")


def stars(several: DataFrame) -> DataFrame:
    """(a, b): every set b of a bucket with the bucket's set a that meets most others over all its buckets."""
    counts = several.groupBy("key").count()
    weight = several.join(counts, "key").groupBy("id").agg(F.sum("count").alias("weight"))
    lead = several.join(weight, "id").groupBy("key").agg(F.max(F.struct("weight", "id")).alias("lead"))
    return several.join(lead, "key").select(F.col("lead.id").alias("a"), F.col("id").alias("b")).where("a <> b").distinct()


def cells(several: DataFrame, roots: DataFrame, part: int = PART) -> DataFrame:
    """(key, x, y, at, id, root): the sets of buckets with several roots, in cells of two parts of which at is the row's own.

    Sets under a bucket's most frequent root meet only those of other roots, so a large group costs what differs from it.
    """
    placed = several.join(roots, "id", "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    by_root = placed.groupBy("key", "root").count()
    mixed = by_root.groupBy("key").agg(F.max(F.struct("count", "root")).alias("most"), F.sum("count").alias("total"), F.count("*").alias("roots")).where("roots > 1")
    parts = lambda n: F.ceil(n / part).cast("int")
    mixed = mixed.select("key", F.col("most.root").alias("own"), parts(F.col("total") - F.col("most.count")).alias("minor"), parts(F.col("most.count")).alias("major"))
    rows = placed.join(mixed, "key").withColumn("is_own", F.col("root") == F.col("own"))
    # Parts are numbered: those of other roots first, then those of the most frequent one.
    at = F.when(F.col("is_own"), F.col("minor") + F.pmod(F.xxhash64("id"), "major")).otherwise(F.pmod(F.xxhash64("id"), "minor")).cast("int")
    meets = F.sequence(F.lit(0), F.when(F.col("is_own"), F.col("minor")).otherwise(F.col("minor") + F.col("major")) - 1)
    rows = rows.withColumn("at", at).withColumn("other", F.explode(meets))
    return rows.select("key", F.least("at", "other").alias("x"), F.greatest("at", "other").alias("y"), "at", "id", "root")


def compared(rows: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(a, b, sig_a, sig_b), once each, of the pairs in cells() of different roots whose sizes and sketches allow the similarity."""
    schema = "a long, b long, sig_a long, sig_b long"
    arrow = arrow_schema(schema)
    full = rows.join(sets.select("id", "n", "sig", "sketch"), "id").select("key", "x", "y", "at", "id", "root", "n", "sig", "sketch")

    def pairs(t: pa.Table):
        key, x, y, at, ids, root, n, sig = (t.column(c).to_numpy() for c in range(8))
        sketch = _square(t.column(8))
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        cell = np.cumsum(new)
        inside, within = x == y, np.arange(len(key))
        for step in range(1, len(key)):
            within = within[within < len(key) - step]
            within = within[cell[within + step] == cell[within]]
            if not len(within):
                break
            other = within + step
            small, large = np.minimum(n[within], n[other]), np.maximum(n[within], n[other])
            some = (root[within] != root[other]) & (inside[within] | (at[within] != at[other])) & (small >= needed(large, least))
            i, j = within[some], other[some]
            for k in range(0, len(i), 4096):
                a, b = i[k : k + 4096], j[k : k + 4096]
                same = sketch[a] == sketch[b]
                near = np.flatnonzero(same.sum(axis=1) >= AGREE)
                # Of the bands that both are in, the first gives the pair out; under the trees a set is in one bucket.
                first, band = same[near, : BANDS * ROWS].reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1), key[a[near]] & 63
                near = near[(first == band) | (band == TREES)]
                a, b = a[near], b[near]
                if len(a):
                    first, last = np.where(ids[a] < ids[b], a, b), np.where(ids[a] < ids[b], b, a)
                    yield as_batch([ids[first], ids[last], sig[first], sig[last]], arrow)

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            c = [batch.column(k).to_numpy() for k in range(3)]
            last = np.flatnonzero((c[0] != c[0][-1]) | (c[1] != c[1][-1]) | (c[2] != c[2][-1]))
            open_at = int(last[-1]) + 1 if len(last) else 0  # the last cell may go on
            if held and open_at == 0:
                before = held[-1]
                same = all(before.column(k)[-1].as_py() == batch.column(k)[-1].as_py() for k in range(3))
                if not same:
                    yield from pairs(pa.Table.from_batches(held))
                    held = []
                held.append(batch)
                continue
            yield from pairs(pa.Table.from_batches([*held, batch.slice(0, open_at)])) if open_at else ()
            held = [batch.slice(open_at)]
        if held:
            yield from pairs(pa.Table.from_batches(held))

    return full.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(run, schema)


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b) of different roots."""
    of = lambda c: roots.select(F.col("id").alias(c), F.col("root").alias(f"root_{c}"))
    both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return both.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def joined(docs: DataFrame, several: DataFrame, sets: DataFrame, edges: DataFrame | None, width: int, least: float) -> DataFrame:
    """edges, if any, and those (a, b) between alike sets of a bucket that connect what edges leave apart."""
    roots_of = lambda edges: cut(connected(edges, checkpoint=cut).withColumnRenamed("node", "id"))
    first = cut(apart(stars(several), roots_of(edges)) if edges else stars(several))
    found = alike(docs, likely(first, sets, least), width, least)
    edges = cut(edges.union(found) if edges else found)
    rest = compared(cells(several, roots_of(edges)), sets, least)
    known = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return cut(edges.union(alike(docs, rest.join(known, ["a", "b"], "left_anti"), width, least)))


def links(docs: DataFrame, rows: DataFrame, width: int = WIDTH, least: float = LEAST) -> DataFrame:
    """(a, b) edges between the sets of rows (described() of docs), each alike, whose components are those of all that are alike."""
    given = rows.where("sketch is not null")
    buckets = [cut(tree_buckets(given)), cut(band_buckets(given))]
    some = buckets[0].union(buckets[1]).select("id").distinct()
    sets = cut(given.join(some, "id", "left_semi").select("id", "n", "sig", "sketch").dropDuplicates(["id"]))
    edges = None
    for several in buckets:
        edges = joined(docs, several, sets, edges, width, least)
    return edges


def one_of_each(docs: DataFrame, width: int = WIDTH, least: float = LEAST) -> DataFrame:
    """The rows of docs that stay: of each group of texts linked by the similarity the row with the smallest doc_id, repeated rows once."""
    rows = cut(described(docs, width))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sig")).alias("first")
    roots = connected(links(docs, rows, width, least), checkpoint=cut).withColumnRenamed("node", "id")
    placed = rows.groupBy("id").agg(first).join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    stay = placed.groupBy("root").agg(F.min("first").alias("first")).select("first.doc_id", "first.sig")
    stay = stay.select(row_key(F.col("sig")).alias("__key"))
    kept = docs.withColumn("__key", row_key(row_sig())).join(stay, "__key", "left_semi")
    return kept.dropDuplicates(["__key"]).select(*docs.columns)
