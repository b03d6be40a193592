"""Operator 1: benchmark decontamination by spaced seeds, in DataFrame functions only.

A seed is a window of tokens under a fixed mask that ignores some positions, so that a substitution breaks
only the seeds that look at it. Hashes of all benchmark seeds meet those of all training seeds in a join;
the benchmark side is broadcast only if its counted size is under a bound. Each hit fixes a diagonal, on
which the whole item is laid over the document and compared token by token: an overlap counts if at least
SIMILAR of the item's tokens agree, or if a stretch of it holds LEAST agreeing tokens or more with
substitutions outweighed PENALTY to one. Items of SHORT tokens and fewer have masks of their own, by their length, of
which one at least is whole wherever SIMILAR of the tokens agree; documents are hashed under those that the benchmark's lengths ask for.

Tokens are runs of letters and digits, in lower case. Defined cases: null and token-free texts have no
seeds; an item of fewer than five tokens is found only where all of it stands; a null item_id is an id like others; items with
equal tokens count as one, under the smallest item_id; rows that repeat a doc_id are told apart by their text, and equal rows give equal
results once; other columns are ignored; an empty table on either side gives no overlap.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, row_key, row_sig

#: Token positions that each mask looks at.
MASKS = ((0, 1, 2, 4, 7), (0, 1, 3, 4, 6), (0, 2, 3, 5, 7))
SIMILAR, LEAST, PENALTY = 0.8, 13, 4
#: Items up to here have masks of their own; those under LEAVE_ONE have one for each token that may be substituted.
SHORT, LEAVE_ONE = 15, 10
#: Benchmark seeds that may be broadcast: 16 bytes each, so 64 MB at most.
BROADCAST = 2_000_000
#: Keys of documents that may be broadcast, about 100 bytes each.
KEYS = 500_000


def tokens(text: str = "text") -> Column:
    """The tokens of a text; empty for null and for texts without any."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def short_masks(n: int) -> list[tuple[int, ...]]:
    """Token positions of the masks of an item of n tokens, of which one is untouched by as many substitutions as SIMILAR allows."""
    free = n - math.ceil(SIMILAR * n - 1e-9)
    if not free:
        return [tuple(range(n))]
    if n < LEAVE_ONE:
        return [tuple(i for i in range(n) if i != k) for k in range(n)]
    ends = [round(n * k / (free + 1)) for k in range(free + 2)]
    return [tuple(range(a, b)) for a, b in zip(ends, ends[1:], strict=False)]


def masks_of(lengths: list[int]) -> list[tuple[int, ...]]:
    """MASKS, and those of short items of some lengths, moved to begin at 0; a mask's place in the list goes into its hashes."""
    moved = [tuple(i - m[0] for i in m) for n in lengths for m in short_masks(n)]
    return list(dict.fromkeys([*MASKS, *moved]))


def seeds(rows: DataFrame, keys: list[str], masks: list[tuple[int, ...]] = list(MASKS)) -> DataFrame:
    """keys, at, seed: the hash under each mask at every token where the mask fits; rows has `hashes`, of tokens."""
    span = max(m[-1] for m in masks) + 1
    shifted = [F.slice("hashes", i + 1, F.size("hashes")) if i else F.col("hashes") for i in range(span)]
    at = F.sequence(F.lit(0), F.size("hashes") - 1).alias("at")
    lanes = F.arrays_zip(at, *[x.alias(f"t{i}") for i, x in enumerate(shifted)])
    flat = rows.where("size(hashes) > 0").select(*keys, F.inline(lanes))
    masked = [
        F.when(F.col(f"t{m[-1]}").isNotNull(), F.xxhash64(F.lit(k), *[f"t{i}" for i in m])) for k, m in enumerate(masks)
    ]
    return flat.select(*keys, "at", F.explode(F.array(*masked)).alias("seed")).where("seed is not null")


def item_seeds(bench: DataFrame, lengths: list[int]) -> DataFrame:
    """(item_id, item_at, seed) of all items; lengths has those of the short ones."""
    known, size = masks_of(lengths), F.size("hashes")
    out = seeds(bench.where(size > SHORT), ["item_id"]).select("item_id", F.col("at").alias("item_at"), "seed")
    for n in lengths:
        own = [
            F.struct(F.lit(m[0]).alias("item_at"), F.xxhash64(F.lit(known.index(tuple(i - m[0] for i in m))), *[F.get("hashes", F.lit(i)) for i in m]).alias("seed"))
            for m in short_masks(n)
        ]
        out = out.unionByName(bench.where(size == n).select("item_id", F.inline(F.array(*own))))
    return out.distinct()


def items(benchmark: DataFrame) -> DataFrame:
    """(item_id, words, hashes) of distinct token sequences."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), tokens().alias("words")).where("size(words) > 0")
    rows = rows.groupBy("words").agg(F.min("item_id").alias("item_id"))
    return rows.select("item_id", "words", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))


def hits(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """(key, doc_id, item_id, diagonal) wherever a document and an item share a seed, once each."""
    lengths = sorted(r.n for r in bench.select(F.size("hashes").alias("n")).where(F.col("n") <= SHORT).distinct().collect())  # SHORT at most
    own = cut(item_seeds(bench, lengths))
    small = own.count() <= BROADCAST
    rows = docs.select("key", "doc_id", F.transform(tokens(), lambda w: F.xxhash64(w)).alias("hashes"))
    theirs = seeds(rows, ["key", "doc_id"], masks_of(lengths))
    met = theirs.join(F.broadcast(own) if small else own, "seed")
    return met.select("key", "doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("diagonal")).distinct()


def overlaps(docs: DataFrame, benchmark: DataFrame, similar: float = SIMILAR, least: int = LEAST) -> DataFrame:
    """(key, doc_id, item_id, start_token, n_matched, n_item_tokens, similarity, longest) of every verified overlap.

    One row for a document and an item, of their best diagonal (most agreeing tokens, then first).
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("key", row_key(row_sig()))
    bench = cut(items(benchmark))
    found = cut(hits(rows, bench))
    side = bench.select(F.col("item_id").alias("__item"), F.col("hashes").alias("item"))
    laid = found.join(F.broadcast(side) if side.count() <= BROADCAST // 64 else side, F.col("item_id").eqNullSafe(F.col("__item")))
    hit = found.select("key").distinct()
    own = rows.join(F.broadcast(hit) if found.count() <= min(BROADCAST, KEYS) else hit, "key", "left_semi")  # only texts that have hits move
    own = own.groupBy("key").agg(F.first("text").alias("text")).select("key", F.transform(tokens(), lambda w: F.xxhash64(w)).alias("hashes"))
    both = laid.join(own, "key")
    agree = F.transform(
        "item",
        lambda h, j: F.coalesce(F.get("hashes", (j + F.col("diagonal")).cast("int")) == h, F.lit(False)),
    )
    both = both.select("key", "doc_id", "item_id", "diagonal", F.size("item").alias("n_item_tokens"), agree.alias("agree"))
    # The best stretch: agreeing tokens score 1, others -PENALTY; a sum below zero starts anew.
    zero = F.struct(F.lit(0).alias("score"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(s, a):
        score = F.when(a, s["score"] + 1).otherwise(s["score"] - PENALTY)
        run = F.when(score < 0, 0).when(a, s["run"] + 1).otherwise(s["run"])
        return F.struct(F.greatest(score, F.lit(0)).alias("score"), run.alias("run"), F.greatest(s["best"], run).alias("best"))

    both = both.withColumn("longest", F.aggregate("agree", zero, step, lambda s: s["best"]))
    both = both.withColumn("n_matched", F.size(F.filter("agree", lambda a: a))).withColumn("similarity", F.col("n_matched") / F.col("n_item_tokens"))
    both = both.where((F.col("similarity") >= similar) | (F.col("longest") >= least))
    best = F.row_number().over(Window.partitionBy("key", "item_id").orderBy(F.desc("n_matched"), "diagonal"))
    return both.withColumn("__best", best).where("__best = 1").select(
        "key", "doc_id", "item_id", F.greatest("diagonal", F.lit(0)).cast("long").alias("start_token"),
        F.col("n_matched").cast("long").alias("n_matched"), F.col("n_item_tokens").cast("long").alias("n_item_tokens"), "similarity",
        F.col("longest").cast("long").alias("longest"),
    )


def without_overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that overlap no benchmark item."""
    bad = cut(overlaps(docs, benchmark).select(F.col("key").alias("__key")).distinct())
    bad = F.broadcast(bad) if bad.count() <= min(BROADCAST, KEYS) else bad
    return docs.withColumn("__key", row_key(row_sig())).join(bad, "__key", "left_anti").select(*docs.columns)
