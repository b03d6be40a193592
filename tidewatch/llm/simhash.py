"""Operator 2: near-duplicates by SimHash fingerprints in vantage-point trees.

Fingerprints are reduced to distinct ones first, so copies cost one row. A tree of vantage points,
fitted on a bounded sample, partitions all distinct fingerprints by Hamming distance: each has one home
shard, and visits those shards across a boundary that it lies within the link radius of. By the triangle
inequality every linked pair then meets in the home shard of one of the two. Each shard finds its exact
links with a tree of its own, pruned by the same bounds, and returns one edge per linked fingerprint
instead of all pairs. A shard that dense fingerprints overfill is split into blocks that meet pairwise.
Components of these edges are components of all links.

Defined cases: null and blank texts have fingerprint zero and link like any other; fewer words than a
shingle are one shingle; repeated rows share fingerprint and component; a component's id is its smallest
non-null doc_id; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.dedup import components as connected

from .shared import cut, mapped, passes, row_key, row_sig

SEED, SHINGLE, RADIUS = 42, 4, 4
#: Fingerprints that the tree over all shards is fitted on, at most.
SAMPLE = 32_768
#: Distinct fingerprints meant for one shard, and the most in one block of an overfull one.
SHARD, BLOCK = 32_768, 1 << 20
#: Below so many, a shard's own tree compares all.
LEAF = 1_024
#: The bits of each byte, lowest first.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def majority(of: np.ndarray, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The 64-bit fingerprints of texts that have so many hashes, of which `of` names the text: a bit is set if it is in over half of them."""
    ones = np.zeros((len(counts), 64))
    if len(hashes):
        for k, byte in enumerate(hashes.view(np.uint8).reshape(-1, 8).T):
            seen = np.bincount(of * 256 + byte, minlength=256 * len(counts)).reshape(-1, 256)
            ones[:, 8 * k : 8 * k + 8] = seen @ _BITS
    return np.packbits(2 * ones > counts[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]


def fingerprints(texts: list[bytes], width: int = SHINGLE) -> np.ndarray:
    """The 64-bit fingerprints of texts in UTF-8: a bit is set if it is in over half of the shingles' hashes."""
    hashes, counts, digest = [], np.zeros(len(texts), np.int64), xxhash.xxh64_intdigest
    for i, text in enumerate(texts):
        words = text.translate(_LOWER).split()
        if not words:
            continue
        line = b" ".join(words)
        if len(words) <= width:
            hashes.append(digest(line, SEED))
            counts[i] = 1
            continue
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = [0, *ends[: len(words) - width].tolist()]
        hashes.extend([digest(line[a:b], SEED) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)])
        counts[i] = len(starts)
    return majority(np.repeat(np.arange(len(texts)), counts), np.array(hashes, np.uint64), counts)


def fingerprint_rows(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(doc_id, sig, fp) of every row."""

    def kernel(batch: pa.RecordBatch):
        found = []
        for _, _, data, off in passes(batch.column(1)):
            raw = data.tobytes()
            found.append(fingerprints([raw[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], width))
        yield [batch.column(0), batch.column(2), np.concatenate(found).view(np.int64)]

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_sig().alias("sig"))
    return mapped(rows, kernel, "doc_id long, sig long, fp long")


class VantageTree:
    """Vantage points and radii in the order of a complete binary tree: node i has the children 2i+1 and 2i+2."""

    def __init__(self, sample: np.ndarray, depth: int, seed: int = 1):
        self.depth, n = depth, (1 << depth) - 1
        self.point, self.radius = np.zeros(n, np.uint64), np.zeros(n, np.int64)
        rng, held = np.random.default_rng(seed), {0: sample}
        for node in range(n):
            own = held.pop(node)
            if len(own):
                tried = own[rng.integers(0, len(own), 8)]
                far = np.bitwise_count(tried[:, None] ^ own[None, :]).astype(np.int64)
                best = int(far.std(axis=1).argmax())  # a wide spread of distances prunes most
                self.point[node], self.radius[node] = tried[best], int(np.median(far[best]))
            else:
                far, best = np.zeros((1, 0), np.int64), 0
            inner = far[best] <= self.radius[node]
            held[2 * node + 1], held[2 * node + 2] = own[inner], own[~inner]

    def route(self, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index into fp, shard, whether it is the home): the home shard of each, and the outer shards it visits."""
        index, node, home = np.arange(len(fp)), np.zeros(len(fp), np.int64), np.ones(len(fp), bool)
        for _ in range(self.depth):
            d = np.bitwise_count(fp[index] ^ self.point[node]).astype(np.int64)
            r = self.radius[node]
            inner, outer = d <= r, d > r
            # A home inside a boundary visits the outer side; a visitor follows wherever a home may be near.
            visit_out = (d <= r) & (d > r - radius)
            visit_in = (d > r) & (d <= r + radius) & ~home
            parts = [(inner, 1, home), (outer, 2, home), (visit_out, 2, np.zeros_like(home)), (visit_in, 1, np.zeros_like(home))]
            index, node, home = (
                np.concatenate([index[m] for m, _, _ in parts]),
                np.concatenate([2 * node[m] + side for m, side, _ in parts]),
                np.concatenate([h[m] for m, _, h in parts]),
            )
        return index, node - ((1 << self.depth) - 1), home


def _spread(home: np.ndarray, visit: np.ndarray, radius: int, edges: list) -> None:
    """Edges that connect what the links of home with home and visit connect, by growing over those not reached yet.

    A home looks for others of both kinds, a visitor for homes only; whoever is reached is not looked for
    again, so copies of one text cost one step and no list of pairs.
    """
    all_of = np.concatenate([home, visit])
    linked, met = np.zeros(len(home), bool), np.zeros(len(all_of), bool)
    step = max(1, (1 << 18) // len(all_of))
    for i in range(0, len(home), step):
        near = np.bitwise_count(home[i : i + step, None] ^ all_of[None, :]) <= radius
        own = near.sum(axis=1) > 1
        linked[i : i + step] = own
        met |= near[own].any(axis=0)
    left, guests = home[linked], visit[met[len(home) :]]
    while len(left):
        root, left = left[0], left[1:]
        queue = [(root, True)]
        while queue:
            at, is_home = queue.pop()
            near = np.bitwise_count(left ^ at) <= radius
            if near.any():
                reached, left = left[near], left[~near]
                edges.append(np.stack([np.full(len(reached), root), reached]))
                queue.extend((x, True) for x in reached)
            if is_home and len(guests):
                near = np.bitwise_count(guests ^ at) <= radius
                if near.any():
                    reached, guests = guests[near], guests[~near]
                    edges.append(np.stack([np.full(len(reached), root), reached]))
                    queue.extend((x, False) for x in reached)


def forest(edges: list[np.ndarray]) -> np.ndarray:
    """One edge for each node that is not the smallest of its component: (root, node)."""
    if not edges:
        return np.zeros((2, 0), np.uint64)
    nodes, at = np.unique(np.concatenate(edges, axis=1), return_inverse=True)
    a, b = at.reshape(2, -1)
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for side in (a, b, label[a], label[b]):
            np.minimum.at(new, side, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = label != np.arange(len(nodes))
    return np.stack([nodes[label[other]], nodes[other]])


def links(home: np.ndarray, visit: np.ndarray, radius: int, edges: list, rng: np.random.Generator) -> None:
    """Edges whose components are those of all links in home and between home and visit, by a vantage-point tree."""
    if not len(home) or len(home) + len(visit) < 2:
        return
    if len(home) + len(visit) > LEAF:
        tried = home[rng.integers(0, len(home), 4)]
        far = np.bitwise_count(tried[:, None] ^ home[None, :]).astype(np.int64)
        best = int(far.std(axis=1).argmax())
        d, r = far[best], int(np.median(far[best]))
        inner = d <= r
        if inner.any() and not inner.all():
            dv = np.bitwise_count(visit ^ tried[best]).astype(np.int64)
            links(home[inner], visit[dv <= r + radius], radius, edges, rng)
            links(home[~inner], np.concatenate([visit[dv > r - radius], home[inner & (d > r - radius)]]), radius, edges, rng)
            return
    _spread(home, visit, radius, edges)


def shard_edges(distinct: DataFrame, radius: int, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(a, b) edges between distinct fingerprints in column fp, whose components are those of all links within radius."""
    spark = distinct.sparkSession
    n = distinct.count()
    sample = distinct.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    depth = min(12, max(0, math.ceil(math.log2(max(1, n / shard)))))
    tree = spark.sparkContext.broadcast(VantageTree(sample, depth))  # at most 4,095 nodes

    def route(batch: pa.RecordBatch):
        fp = batch.column(0).to_numpy(zero_copy_only=False)
        index, to, home = tree.value.route(fp.view(np.uint64), radius)
        yield [fp[index], to, home]

    routed = cut(mapped(distinct.select("fp"), route, "fp long, shard long, home boolean"))
    sizes = routed.groupBy("shard").count().select("shard", F.ceil(F.col("count") / block).alias("parts"))  # one row a shard
    part = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("parts"))
    cells = (
        routed.join(F.broadcast(sizes), "shard")
        .withColumn("part", part)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        .select("fp", "home", "shard", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    )

    def join(t: pa.Table) -> pa.Table:
        fp, home = t["fp"].to_numpy().view(np.uint64), t["home"].to_numpy(zero_copy_only=False).astype(bool)
        edges: list = []
        links(np.sort(fp[home]), np.sort(fp[~home]), radius, edges, np.random.default_rng(len(fp)))
        both = forest(edges).view(np.int64)
        return pa.table({"a": both[0], "b": both[1]})

    return cells.groupBy("shard", "i", "j").applyInArrow(join, "a long, b long")


def components(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, component_id, keep_id, keep_sig) of every distinct fp of prints (doc_id, sig, fp).

    component_id is the smallest doc_id of the component; keep_id and keep_sig name the row that stays of it.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sig")).alias("first")
    distinct = cut(prints.groupBy("fp").agg(first))
    roots = cut(connected(shard_edges(distinct, radius), checkpoint=cut))
    placed = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = cut(placed.groupBy("root").agg(F.min("first").alias("first")))  # so that a hot root's rows can be split in the join
    return placed.select("fp", "root").join(ids, "root").select(
        "fp", F.col("first.doc_id").alias("component_id"), F.col("first.doc_id").alias("keep_id"), F.col("first.sig").alias("keep_sig")
    )


def near_duplicates(docs: DataFrame, radius: int = RADIUS, width: int = SHINGLE) -> DataFrame:
    """Every row's doc_id, sig, fingerprint, component and the row that stays of it."""
    prints = cut(fingerprint_rows(docs, width))
    return prints.join(components(prints, radius), "fp").select(
        "doc_id", "sig", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "keep_id", "keep_sig"
    )


def one_of_each(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of docs that stay: of each component the row with the smallest doc_id, repeated rows once."""
    found = near_duplicates(docs, radius)
    stay = found.where(F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("sig") == F.col("keep_sig")))
    stay = stay.select(row_key(F.col("sig")).alias("__key")).distinct()
    rows = docs.withColumn("__key", row_key(row_sig())).join(stay, "__key", "left_semi")
    return rows.dropDuplicates(["__key"]).select(*docs.columns)
