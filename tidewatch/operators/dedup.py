"""Near-duplicates inside clusters: pairs, greedy in time, and transitive."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.session import shared_folder

from .blocks import dealt, matrix, meeting

#: Presets: similarity and hours of the greedy and of the transitive variant.
GREEDY, TRANSITIVE = (0.95, 72), (0.85, 96)
_HOUR = 3_600_000_000
#: Edges that one task joins, at most, and nodes of a partition's forest at a time.
SMALL, BATCH = 16_384, 1 << 20
#: Rows of a block, of which two meet in a task.
BLOCK = 4_096


def _columns(articles: DataFrame, cluster: str) -> DataFrame:
    at = F.unix_micros(F.col("published_at").cast("timestamp"))
    return articles.select(F.col(cluster).alias("cluster"), F.col("article_id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("v"), at.alias("at"))


def similar_pairs(articles: DataFrame, theta: float, hours: float, cluster: str = "cluster_id", block: int = BLOCK) -> DataFrame:
    """(cluster, a, b, similarity) of pairs of one cluster within some hours (an unknown time passes) whose dot reaches theta, rounded to 9 places.

    A cluster's rows are dealt to blocks that meet in pairs, so a large cluster is many tasks. There, rows of a stretch of time are
    compared with those that the hours let them reach.
    """
    rows = _columns(articles, cluster)
    placed, _, tasks = dealt(rows, "cluster", "id", block)

    def pairs(t: pa.Table) -> pa.Table:
        t = t.sort_by("at")
        ids, v, same = t["id"].to_numpy(zero_copy_only=False), matrix(t["v"]), t["__i"][0] == t["__j"][0]
        at = t["at"].cast(pa.float64()).to_numpy(zero_copy_only=False)
        own = t["__b"].to_numpy() == t["__i"][0].as_py()
        left, right = np.flatnonzero(own), np.flatnonzero(own if same else ~own)
        a, b, s = [], [], []
        for i in range(0, len(left), 1024):
            part = left[i : i + 1024]
            times, reach = at[part], hours * _HOUR
            there = right
            if not np.isnan(times).any():
                there = right[~((at[right] < times.min() - reach) | (at[right] > times.max() + reach))]
            sims = np.round(v[part] @ v[there].T, 9)
            near = ~(np.abs(times[:, None] - at[there]) > reach)
            x, y = np.nonzero(near & (sims >= theta))
            p, q, sim = part[x], there[y], sims[x, y]
            if same:
                once = (ids[p] < ids[q]) | ((ids[p] == ids[q]) & (p < q))
                p, q, sim = p[once], q[once], sim[once]
            first = ids[p] <= ids[q]
            a.append(np.where(first, ids[p], ids[q])), b.append(np.where(first, ids[q], ids[p])), s.append(sim)
        cat = lambda parts: np.concatenate(parts) if parts else []
        n = sum(map(len, a))
        return pa.table({"cluster": pa.repeat(t["cluster"][0], n), "a": pa.array(cat(a), pa.string()), "b": pa.array(cat(b), pa.string()), "similarity": pa.array(cat(s), pa.float64())})

    kind = dict(rows.dtypes)["cluster"]
    met = meeting(placed, "cluster", tasks)
    return met.groupBy("cluster", "__i", "__j").applyInArrow(pairs, f"cluster {kind}, a string, b string, similarity double")


def _fold(t: pa.Table, theta: float, hours: float) -> list[str | None]:
    """For each row, in time order, the first row kept before it that is near in both ways; null for those that are kept."""
    ids, v, at = t["id"].to_pylist(), matrix(t["v"]) if len(t) else np.zeros((0, 0)), t["at"].to_pylist()
    kept: list[int] = []
    kept_v = np.empty_like(v)
    of: list[str | None] = [None] * len(ids)
    for i in sorted(range(len(ids)), key=lambda i: (at[i] is not None, at[i] or 0, ids[i])):
        sims = np.round(kept_v[: len(kept)] @ v[i], 9)
        for k in np.flatnonzero(sims >= theta).tolist():
            j = kept[k]
            if at[i] is None or at[j] is None or abs(at[i] - at[j]) <= hours * _HOUR:
                of[i] = ids[j]
                break
        else:
            kept_v[len(kept)] = v[i]
            kept.append(i)
    return of


def greedy_duplicates(articles: DataFrame, theta: float = GREEDY[0], hours: float = GREEDY[1], cluster: str = "cluster_id", block: int = BLOCK) -> DataFrame:
    """(cluster, id, duplicate_of): in time order, undated first, an article is a duplicate iff an earlier canonical one is within
    the hours (an unknown time passes) and its dot reaches theta; duplicate_of is the first such, null for canonical ones.

    Clusters of at most `block` rows are folded in one task each. A larger one goes in waves: its first rows are folded, and those of them that are
    canonical are sent to blocks of the others, which lose what is near to them; so each row meets the canonical ones before it only,
    copies go with the first wave, and no task holds more than a block and a wave's canonical rows.
    """
    rows = _columns(articles, cluster)
    kind = dict(rows.dtypes)["cluster"]
    schema = f"cluster {kind}, id string, duplicate_of string"

    def fold(t: pa.Table) -> pa.Table:
        return pa.table({"cluster": t["cluster"], "id": t["id"], "duplicate_of": pa.array(_fold(t, theta, hours), pa.string())})

    large = rows.groupBy(F.col("cluster").alias("__c")).agg(F.count("*").alias("n")).where(F.col("n") > block)
    large = checkpointed(large)
    if large.isEmpty():
        return rows.groupBy("cluster").applyInArrow(fold, schema)
    same = F.col("cluster").eqNullSafe(F.col("__c"))
    done = rows.join(large, same, "left_anti").groupBy("cluster").applyInArrow(fold, schema)
    rest = checkpointed(rows.join(large.select("__c"), same, "left_semi"))

    def near(kept: pa.Table, own: pa.Table) -> pa.Table:
        """The first of the kept rows that each own row is a duplicate of."""
        of: list[str | None] = [None] * len(own)
        if len(kept) and len(own):
            kept = kept.append_column("dated", pc.is_valid(kept["at"])).sort_by([("dated", "ascending"), ("at", "ascending"), ("id", "ascending")])
            x, y, names = matrix(kept["v"]), matrix(own["v"]), kept["id"].to_pylist()
            a, b = (t["at"].cast(pa.float64()).to_numpy(zero_copy_only=False) for t in (kept, own))
            for i in range(0, len(own), 1024):
                hit = (np.round(y[i : i + 1024] @ x.T, 9) >= theta) & ~(np.abs(b[i : i + 1024, None] - a) > hours * _HOUR)
                for k in np.flatnonzero(hit.any(axis=1)).tolist():
                    of[i + k] = names[int(hit[k].argmax())]
        return pa.table({"cluster": own["cluster"], "id": own["id"], "v": own["v"], "at": own["at"], "duplicate_of": pa.array(of, pa.string())})

    order = Window.partitionBy("cluster").orderBy(F.asc_nulls_first("at"), "id")
    while not rest.isEmpty():
        first = rest.withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= block).drop("__k")  # cut before the shuffle
        head = checkpointed(first.groupBy("cluster").applyInArrow(fold, schema))
        done = done.unionByName(head)
        met = head.select(F.col("cluster").alias("__c"), F.col("id").alias("__i"), F.col("duplicate_of").isNull().alias("__kept"))
        mine = F.col("cluster").eqNullSafe(F.col("__c")) & (F.col("id") == F.col("__i"))
        kept, others = rest.join(met.where("__kept"), mine, "left_semi"), rest.join(met, mine, "left_anti")
        parts = others.groupBy(F.col("cluster").alias("__c")).agg(F.ceil(F.count("*") / block).cast("int").alias("__n"))
        parts = checkpointed(parts)
        total = parts.agg(F.sum("__n")).first()[0]
        if not total:
            break
        joined = lambda df: df.join(parts, F.col("cluster").eqNullSafe(F.col("__c"))).drop("__c")
        own = joined(others).withColumn("__b", F.pmod(F.xxhash64("id"), "__n").cast("int")).drop("__n")
        sent = joined(kept).withColumn("__b", F.explode(F.sequence(F.lit(0), F.col("__n") - 1))).drop("__n")
        own, sent = (df.select(*[F.col(c).alias(c) for c in df.columns]) for df in (own, sent))  # they come of one table
        both = [df.repartition(min(total, 20_000), "cluster", "__b").groupBy("cluster", "__b") for df in (sent, own)]
        met = checkpointed(both[0].cogroup(both[1]).applyInArrow(near, f"cluster {kind}, id string, v array<double>, at long, duplicate_of string"))
        done = done.unionByName(met.where("duplicate_of is not null").select("cluster", "id", "duplicate_of"))
        rest = met.where("duplicate_of is null").drop("duplicate_of")
    return done


def components(edges: DataFrame, a: str = "a", b: str = "b", checkpoint=None, small: int = SMALL) -> DataFrame:
    """(node, root) of all nodes of an edge table; root is the smallest node of its component.

    Every partition first keeps a forest of its own edges, which connects the same. At most `small` edges are then joined in
    one task; of more, stars are contracted in turn around smaller and larger neighbours until no edge moves. checkpoint cuts
    the lineage of a round, by default in the session's checkpoint folder.
    """
    keep = checkpoint or checkpointed
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v")
    kind = dict(now.dtypes)["u"]
    now = keep(now.mapInArrow(_forest, f"u {kind}, v {kind}").distinct())
    if now.limit(small + 1).count() <= small:
        tree = now.coalesce(1).mapInArrow(_forest, f"u {kind}, v {kind}")
        return tree.select(F.col("u").alias("node"), F.col("v").alias("root")).union(tree.select("v", "v").distinct())
    mark = None
    while True:
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        out = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = out.groupBy("u").agg(F.min("v").alias("m"))
        out = out.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low).distinct()
        now = keep(out)
        last, mark = mark, now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == last or not mark[0]:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())


def _forest(batches):
    """An edge from every node to the smallest of its component, by the edges of one partition; it is given out and begun anew
    when it has grown to BATCH nodes, so that memory is bounded."""
    top: dict = {}
    schema = None

    def find(x):
        while top[x] != x:
            top[x] = x = top[top[x]]
        return x

    def out():
        nodes = [x for x in top if top[x] != x]
        return pa.RecordBatch.from_arrays([pa.array(nodes, schema.field(0).type), pa.array([find(x) for x in nodes], schema.field(1).type)], schema=schema)

    for batch in batches:
        schema = batch.schema
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            top.setdefault(u, u), top.setdefault(v, v)
            x, y = find(u), find(v)
            if x != y:
                top[max(x, y)] = min(x, y)
        if len(top) >= BATCH:
            yield out()
            top.clear()
    if top:
        yield out()


def checkpointed(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint()


def transitive_duplicates(articles: DataFrame, theta: float = TRANSITIVE[0], hours: float = TRANSITIVE[1], cluster: str = "cluster_id") -> DataFrame:
    """(id, canonical_id) of articles linked to others, directly or through others: the earliest of a component stands for it, undated first."""
    nodes = components(similar_pairs(articles, theta, hours, cluster))
    at = articles.select(F.col("article_id").cast("string").alias("node"), F.col("published_at").alias("at"))
    rows = nodes.join(at, "node")
    first = rows.groupBy("root").agg(F.min_by("node", F.struct(F.col("at").isNotNull().alias("dated"), "at", "node")).alias("canonical_id"))
    return rows.join(first, "root").select(F.col("node").alias("id"), "canonical_id")


def within_hours(a: Column, b: Column, hours: float) -> Column:
    return F.coalesce(F.abs(F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))) <= hours * _HOUR, F.lit(True))
