"""Operator 8: mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern: the set of sources that hold the same text. The flow network has
a node per pattern and per source: a pattern offers the words of its distinct texts once at cost 1, a second time at cost
3, a third at cost 5 and what copies allow beyond at cost 7, so marginal costs rise with every use of a text, whichever source it is for;
an edge leads from a pattern to each of its sources, with room for REPEATS times that source's rows, and a source's edge to the
sink holds its quota. The driver solves this network of patterns, not documents. The words that a pattern sends to a source
are then spread over that source's rows: one row of each text first, copies once those are used up. Texts have one
seeded order in a pattern and its sources take consecutive stretches of it, round and round, so no text is used
again before all others are. Stretches are found by sums over hash buckets and an exact order within the buckets that one ends in.

Defined cases: null text has size 0; a null source is a source of its own, ordered last; with no words at
all every target is 0; repeated rows count each and share what their text takes evenly; other columns are ignored; an empty
table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, mapped, passes, row_key, row_sig
from .words import Words

WEIGHTS = (5, 2, 1)
#: The most that a document is repeated, the marginal cost of each use of a text, and of uses beyond, by its copies.
REPEATS = 3
COSTS, BEYOND = (1, 3, 5), 7
SEED = 8
#: Buckets of the seeded order; one of them is ordered exactly.
BUCKETS = 1 << 12


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, sig, size) of every row; size counts words."""

    def kernel(batch: pa.RecordBatch):
        for i, j, data, off in passes(batch.column(1)):
            rows = batch.slice(i, j - i)
            yield [rows.column(0), rows.column(2), rows.column(3), Words(data, off).n]

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source", row_sig().alias("sig"))
    return mapped(rows, kernel, "doc_id long, source string, sig long, size long")


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, most: int = REPEATS) -> dict[str | None, float]:
    """Shares of all sizes by weight, each at most `most` times its source; the excess is shared again by weight."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full: dict[str | None, float] = {}
    while True:
        free = [s for s in order if s not in full]
        left = sum(sizes.values()) - sum(full.values())
        total = sum(weight[s] for s in free)
        share = {s: left * weight[s] / total for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return {s: full.get(s, share.get(s, 0.0)) for s in order}
        full |= {s: float(most * sizes[s]) for s in over}


def min_cost_flow(
    supply: list, members: list[list[int]], quota: list[int], costs: tuple[int, ...] = COSTS, room: list[dict[int, int]] | None = None
) -> list[dict[int, int]]:
    """Words from each pattern to each of its sources, filling as much of the quotas as can be at least cost.

    supply: the words that a pattern offers at each cost, one number or one for each; room: the most from a pattern to a source.
    All cost lies on what a pattern offers, so the cheapest paths are those of the lowest cost that still has words: a maximum
    flow at each cost in turn, on top of the flow before it, costs least. Flows grow along shortest paths by layers.
    """
    p, s = len(supply), len(quota)
    start, end = p + s, p + s + 1
    to: list[int] = []
    cap: list[int] = []
    out: list[list[int]] = [[] for _ in range(end + 1)]

    def edge(a: int, b: int, c: int) -> int:
        for u, v, most in ((a, b, c), (b, a, 0)):
            out[u].append(len(to))
            to.append(v), cap.append(most)
        return len(to) - 2

    offers = [x if isinstance(x, (list, tuple)) else [x] * len(costs) for x in supply]
    feed = [edge(start, i, 0) for i in range(p)]
    pairs = [{k: edge(i, p + k, sum(offers[i]) if room is None else room[i][k]) for k in members[i]} for i in range(p)]
    for k in range(s):
        edge(p + k, end, quota[k])

    def grow() -> None:
        while True:
            layer, queue = [-1] * (end + 1), [start]
            layer[start] = 0
            for u in queue:
                for e in out[u]:
                    if cap[e] and layer[to[e]] < 0:
                        layer[to[e]] = layer[u] + 1
                        queue.append(to[e])
            if layer[end] < 0:
                return
            at, path, u = [0] * (end + 1), [], start
            while True:
                if u == end:
                    words = min(cap[e] for e in path)
                    for e in path:
                        cap[e] -= words
                        cap[e ^ 1] += words
                    full = next(i for i, e in enumerate(path) if not cap[e])
                    u = to[path[full] ^ 1]
                    del path[full:]
                    continue
                while at[u] < len(out[u]):
                    e = out[u][at[u]]
                    if cap[e] and layer[to[e]] == layer[u] + 1:
                        break
                    at[u] += 1
                else:
                    if u == start:
                        break
                    u = to[path.pop() ^ 1]
                    at[u] += 1
                    continue
                path.append(e)
                u = to[e]

    for step in sorted(range(len(costs)), key=costs.__getitem__):
        for i, e in enumerate(feed):
            cap[e] += offers[i][step]
        grow()
    return [{k: cap[e ^ 1] for k, e in own.items() if cap[e ^ 1]} for own in pairs]


def select(rows: DataFrame, quota: DataFrame, seed: int = SEED) -> DataFrame:
    """rows (cell, doc_id, sig, size, n: how often the row is repeated, by_id: whether the order looks at ids) with `taken`: a cell's words come to its quota's `words`.

    Whole repetitions go to all rows of a cell; the rest to those in a stretch of the seeded order that begins `offset`
    words after its start and goes round. quota: cell, words, offset; one row a cell.
    """
    rows = rows.withColumn("__order", F.xxhash64(F.lit(seed), "sig", F.when(F.col("by_id"), F.col("doc_id")))).withColumn("__all", F.col("size") * F.col("n"))
    rows = rows.withColumn("__bucket", F.shiftrightunsigned("__order", 52).cast("int"))
    sums = rows.groupBy("cell", "__bucket").agg(F.sum("__all").alias("words_in"))
    at = Window.partitionBy("cell").orderBy("__bucket")  # at most BUCKETS rows a cell
    sums = sums.withColumn("before", F.sum("words_in").over(at) - F.col("words_in")).withColumn("total", F.sum("words_in").over(Window.partitionBy("cell")))
    placed = sums.join(quota, "cell").where("total > 0")
    placed = placed.withColumn("whole", F.floor(F.col("words") / F.col("total")).cast("long")).withColumn("begin", F.col("offset") % F.col("total"))
    placed = placed.withColumn("stop", F.col("begin") + F.col("words") % F.col("total"))

    def inside(start: Column, length: Column) -> Column:
        """How much of a piece of the order lies in the stretch, which may go round."""
        once = lambda by: F.greatest(F.lit(0), F.least(start + length, F.col("stop") - by) - F.greatest(start, F.col("begin") - by))
        return once(F.lit(0)) + once(F.col("total"))

    placed = placed.withColumn("held", inside(F.col("before"), F.col("words_in")))
    placed = placed.select("cell", "__bucket", "whole", "before", "begin", "stop", "total", "held", "words_in")
    known = rows.join(placed, ["cell", "__bucket"], "left")
    split = (F.col("held") > 0) & (F.col("held") < F.col("words_in"))
    fixed = known.where(~F.coalesce(split, F.lit(False)))
    fixed = fixed.withColumn("all_taken", F.coalesce(F.col("__all") * (F.col("whole") + F.when(F.col("held") > 0, 1).otherwise(0)), F.lit(0)))
    exact = Window.partitionBy("cell", "__bucket").orderBy("__order", "sig", "doc_id")  # of the few buckets that a stretch ends in
    start = F.col("before") + F.sum("__all").over(exact.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__all")
    ended = known.where(split).withColumn("__start", start).withColumn("all_taken", F.col("__all") * F.col("whole") + inside(F.col("__start"), F.col("__all"))).drop("__start")
    both = fixed.unionByName(ended).drop("__order", "__all", "__bucket", "before", "begin", "stop", "total", "held", "words_in", "whole")
    both = both.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return both.withColumn("taken", F.expr("all_taken * (copy + 1) div n - all_taken * copy div n")).drop("all_taken", "n", "by_id")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """Every row's doc_id, sig, copy (0 and up among repeated rows), source, size, source_size, target, taken, and its text's pattern of sources."""
    spark = docs.sparkSession
    rows = cut(sized(docs).groupBy("doc_id", "source", "sig", "size").agg(F.count("*").alias("n")))
    sizes = {r.source: r.n for r in rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("n")).collect()}  # a row a source
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    wanted = targets(sizes, weights)
    of = spark.createDataFrame([(s, k, sizes[s], wanted[s]) for k, s in enumerate(names)], "source string, k int, source_size long, target double")
    rows = rows.join(F.broadcast(of.withColumnRenamed("source", "__s")), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    # A text's first row in each of its sources, and the set of these sources.
    firsts = rows.groupBy("sig", "k").agg(F.min("doc_id").alias("first"))
    firsts = firsts.groupBy("sig").agg(F.array_sort(F.collect_list(F.struct("k", "first"))).alias("__own"))
    rows = rows.join(firsts, "sig").withColumn("pattern", F.concat_ws(",", F.transform("__own", lambda x: x["k"].cast("string"))))
    first = F.element_at(F.filter("__own", lambda x: x["k"] == F.col("k")), 1)["first"]
    rows = cut(rows.withColumn("by_id", ~F.col("doc_id").eqNullSafe(first)).drop("__own"))
    sums = rows.groupBy("pattern", "k", "by_id").agg(F.sum(F.col("size") * F.col("n")).alias("words")).collect()  # two rows a pattern and source
    held = {(r.pattern, r.k, r.by_id): r.words for r in sums}
    patterns = sorted({p for p, _, _ in held})
    members = [[int(k) for k in p.split(",")] for p in patterns]
    once = [min(held.get((p, k, False), 0) for k in own) for p, own in zip(patterns, members, strict=True)]
    room = [{k: REPEATS * (held.get((p, k, False), 0) + held.get((p, k, True), 0)) for k in own} for p, own in zip(patterns, members, strict=True)]
    offers = [[x] * REPEATS + [max(0, sum(own.values()) - REPEATS * x)] for x, own in zip(once, room, strict=True)]
    flow = min_cost_flow(offers, members, [round(wanted[s]) for s in names], (*COSTS, BEYOND), room)
    plan = []
    for p, own, sent in zip(patterns, members, flow, strict=True):
        offset = 0
        for k in own:
            words = sent.get(k, 0)
            fresh = min(words, REPEATS * held.get((p, k, False), 0))
            plan += [(f"{p}|{k}|false", fresh, offset), (f"{p}|{k}|true", words - fresh, 0)]
            offset += fresh
    quota = spark.createDataFrame(plan, "cell string, words long, offset long")
    cell = F.concat_ws("|", "pattern", F.col("k").cast("string"), F.col("by_id").cast("string"))
    found = select(rows.withColumn("cell", cell), quota, seed)
    return found.select("doc_id", "sig", "copy", "source", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"), "pattern")


def mix_overlapping(docs: DataFrame, sources: Column, shares: dict[str, float], seed: int = SEED) -> DataFrame:
    """(doc_id, sig, pattern, size, taken) of documents that may each serve several sources (an array column).

    shares: the words that each source should get as a share of all words. The flow decides which pattern
    serves which source; a document's words count once for each use, whichever source it is for.
    """
    pattern = F.array_join(F.array_sort(F.array_distinct(sources)), "\u0001")
    ids = docs.select("doc_id", "text", pattern.alias("source"))
    rows = cut(sized(ids)).withColumnRenamed("source", "pattern")
    sums = {r.pattern: r.n for r in rows.groupBy("pattern").agg(F.sum("size").alias("n")).collect()}  # a row a pattern
    names, wanted = list(sums), sorted(shares)
    members = [[wanted.index(s) for s in (p or "").split("\u0001") if s in shares] for p in names]
    total = sum(sums.values())
    flow = min_cost_flow([sums[p] for p in names], members, [int(np.floor(total * shares[s])) for s in wanted])
    plan = docs.sparkSession.createDataFrame([(p or "", sum(f.values()), 0) for p, f in zip(names, flow, strict=True)], "cell string, words long, offset long")
    rows = rows.withColumns({"cell": F.coalesce("pattern", F.lit("")), "n": F.lit(1).cast("long"), "by_id": F.lit(True)})
    return select(rows, plan, seed).select("doc_id", "sig", "pattern", "size", F.col("taken").cast("long").alias("taken"))


def mixed_rows(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """The rows of docs that the mix takes words of, with size, target and taken in place of columns of these names."""
    found = mix(docs, weights, seed).select("source", "copy", "size", "target", "taken", row_key(F.col("sig")).alias("__key")).where("taken > 0")
    found = found.select("__key", F.col("source").alias("__source"), F.col("copy").alias("__copy"), *[F.col(c).alias(f"__{c}") for c in ("size", "target", "taken")])
    keyed = docs.withColumn("__key", row_key(row_sig()))
    twice = cut(keyed.groupBy("__key", "source").agg(F.count("*").alias("n")).where("n > 1").select("__key", F.col("source").alias("__t")))
    own = [c for c in docs.columns if c not in ("size", "target", "taken")]
    new = [F.col(f"__{c}").alias(c) for c in ("size", "target", "taken")]

    def join(rows: DataFrame) -> DataFrame:
        right = found.withColumnRenamed("__key", "__k")
        on = (F.col("__key") == F.col("__k")) & F.col("source").eqNullSafe(F.col("__source")) & (F.col("__at") == F.col("__copy"))
        return rows.join(right, on).select(*own, *new)

    if twice.isEmpty():
        return join(keyed.withColumn("__at", F.lit(0)))
    one = keyed.join(twice.withColumnRenamed("__key", "__tk"), (F.col("__key") == F.col("__tk")) & F.col("source").eqNullSafe(F.col("__t")), "left_anti")
    many = keyed.join(twice.withColumnRenamed("__key", "__tk"), (F.col("__key") == F.col("__tk")) & F.col("source").eqNullSafe(F.col("__t")), "left_semi")
    # Rows that repeat id, text and source are equal but for other columns; which of them is which matters to none.
    at = F.row_number().over(Window.partitionBy("__key", "source").orderBy(F.lit(0))) - 1
    return join(one.withColumn("__at", F.lit(0)).unionByName(many.withColumn("__at", at)))
