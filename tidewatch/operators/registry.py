"""The registry that gives clusters the identity of known events across runs."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.vector import dot

from . import dedup
from .blocks import facing, matrix

THETA = 0.85
SETTLED = ("closed", "rejected")
#: Clusters that are broadcast, at most.
FEW = 1_000


def matchable(events: DataFrame) -> DataFrame:
    return events.where(F.col("centroid").isNotNull() & ~F.coalesce(F.col("status"), F.lit("")).isin(*SETTLED))


def _nearest(clusters: DataFrame, events: DataFrame, theta: float, most: int | None, digits: int = 9, few: int = FEW) -> DataFrame:
    """(cluster_id, event_id, similarity): live events of each cluster at theta or more. Up to `few` clusters are counted and sent to
    every part of the events; of more, blocks of both sides meet, and each pair of blocks gives the nearest `most` (None: all), the smaller
    event_id first on ties. Centroids of different dimensions match nothing."""
    known = matchable(events).select("event_id", "centroid")
    new = clusters.where(F.col("centroid").isNotNull()).select("cluster_id", "centroid")
    if new.limit(few + 1).count() <= few:
        sim = F.round(dot(F.col("centroid"), F.col("__c")), digits)
        rows = known.join(F.broadcast(new.select("cluster_id", F.col("centroid").alias("__c"))))
        return rows.select("cluster_id", "event_id", sim.alias("similarity")).where(F.col("similarity") >= theta)
    kinds = dict(known.dtypes)["event_id"], dict(new.dtypes)["cluster_id"]

    def near(e: pa.Table, c: pa.Table) -> pa.Table:
        e, ids, found, sims = e.sort_by("event_id"), [], [], []
        sizes = [pc.list_value_length(t["centroid"]).to_numpy() for t in (e, c)]
        for size in np.unique(sizes[1]).tolist():
            here, own = (np.flatnonzero(s == size) for s in sizes)
            if not len(here):
                continue
            x, y = (matrix(t["centroid"].take(pa.array(at))) for t, at in ((e, here), (c, own)))
            for i in range(0, len(own), 128):
                s = np.round(y[i : i + 128] @ x.T, digits)
                for k, row in zip(own[i : i + 128].tolist(), s, strict=True):
                    at = np.flatnonzero(row >= theta)
                    at = at[np.argsort(-row[at], kind="stable")[:most]]
                    ids.append(np.full(len(at), k)), found.append(here[at]), sims.append(row[at])
        cat = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
        return pa.table({"cluster_id": c["cluster_id"].take(pa.array(cat(ids, np.int64))), "event_id": e["event_id"].take(pa.array(cat(found, np.int64))), "similarity": cat(sims, float)})

    return facing(known, new, "event_id", "cluster_id", near, f"cluster_id {kinds[1]}, event_id {kinds[0]}, similarity double")


def best_match(clusters: DataFrame, events: DataFrame, theta: float = THETA, digits: int = 9, few: int = FEW) -> DataFrame:
    """(cluster_id, event_id, similarity): for each cluster the live event of the largest dot of centroids if it reaches theta;
    smaller event_id on ties."""
    best = F.min_by(F.struct("event_id", "similarity"), F.struct((-F.col("similarity")).alias("s"), "event_id"))
    return _nearest(clusters, events, theta, 1, digits, few).groupBy("cluster_id").agg(best.alias("b")).select("cluster_id", "b.event_id", "b.similarity")


def identify(clusters: DataFrame, events: DataFrame, theta: float = THETA) -> DataFrame:
    """(cluster_id, event_id, is_new, similarity) of the clusters of one run (cluster_id, centroid, first_id), as if taken in order of cluster_id.

    A cluster takes the nearest live event whose centroid reaches theta, by the registry or as an earlier cluster of the run has set it;
    smaller event_id on ties; else it is a new one. The order matters only among clusters that share events or are near each
    other, directly or through others: each such component is folded by itself, over similarities and no vectors. Of k clusters of a component at
    most k - 1 events have moved before one is taken, so that its k nearest events of the registry are enough.
    """
    keep = dedup.checkpointed
    kind = dict(clusters.dtypes)["cluster_id"]
    new = keep(clusters.select("cluster_id", "centroid", F.col("first_id").cast("string").alias("first_id")))
    near = keep(_nearest(new, events, theta, None))
    valid = new.where("centroid is not null").select(F.lit(0).alias("run"), F.size("centroid").alias("k"), F.col("cluster_id").alias("article_id"), F.col("centroid").alias("embedding"), F.lit(None).cast("timestamp").alias("published_at"))
    peers = keep(dedup.similar_pairs(valid, theta, math.inf, "k").select("a", "b", F.col("similarity").alias("s")))
    name = lambda c, sign: F.concat(F.lit(sign), c.cast("string"))
    links = near.select(name(F.col("cluster_id"), "c").alias("a"), name(F.col("event_id"), "e").alias("b"))
    links = links.union(peers.select(name(F.col("a"), "c"), name(F.col("b"), "c")))
    part = keep(dedup.components(links)).where(F.startswith("node", F.lit("c"))).select(F.expr("substring(node, 2)").alias("__id"), "root")
    rows = new.select("cluster_id", "first_id", F.col("cluster_id").cast("string").alias("__id")).join(part, "__id", "left")
    rows = keep(rows.withColumn("root", F.coalesce("root", name(F.col("cluster_id"), "c"))))
    sizes = rows.groupBy("root").agg(F.count("*").alias("__k"))
    order = Window.partitionBy("cluster_id").orderBy(F.desc("similarity"), "event_id")
    options = near.join(rows.select("cluster_id", "root"), "cluster_id").join(sizes, "root").withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= F.col("__k"))
    none = lambda t: F.lit(None).cast(t)
    facts = options.select("root", "cluster_id", "event_id", none("string").alias("other"), F.col("similarity").alias("s"), none("string").alias("first_id"))
    apart = peers.union(peers.select("b", "a", "s")).select(F.col("a").alias("__id"), F.col("b").alias("other"), "s")
    facts = facts.unionByName(apart.join(rows, "__id").select("root", "cluster_id", none("string").alias("event_id"), "other", "s", none("string").alias("first_id")))
    facts = facts.unionByName(rows.select("root", "cluster_id", none("string").alias("event_id"), none("string").alias("other"), none("double").alias("s"), "first_id"))

    def fold(t: pa.Table) -> pa.Table:
        ids, choices, others, first = [], {}, {}, {}
        for _, c, e, o, s, f in zip(*(x.to_pylist() for x in t.columns), strict=True):
            if e is not None:
                choices.setdefault(c, []).append((-s, e))
            elif o is not None:
                others.setdefault(c, []).append((o, s))
            else:
                ids.append(c)
                first[c] = f
        taken: dict[str, str] = {}  # the event of each cluster so far
        holder: dict[str, str] = {}  # the cluster whose centroid an event has now
        out = []
        for c in sorted(ids):
            found = [(-s, taken[o]) for o, s in others.get(c, []) if o in taken and holder[taken[o]] == o]
            found += next(([x] for x in sorted(choices.get(c, [])) if x[1] not in holder), [])
            if found:
                s, event = min(found)
            else:
                s, event = None, hashlib.sha256(f"{c}|{first[c]}".encode()).hexdigest()[:32]
            taken[str(c)], holder[event] = event, str(c)
            out.append((c, event, not found, None if s is None else -s))
        columns = list(zip(*out, strict=True))
        kinds = (t["cluster_id"].type, pa.string(), pa.bool_(), pa.float64())
        return pa.table({n: pa.array(x, k) for n, x, k in zip(("cluster_id", "event_id", "is_new", "similarity"), columns, kinds, strict=True)})

    return facts.groupBy("root").applyInArrow(fold, f"cluster_id {kind}, event_id string, is_new boolean, similarity double")


def assign(clusters: DataFrame, events: DataFrame, theta: float = THETA) -> list[dict]:
    """The rows of identify in order, for small runs."""
    return [r.asDict() for r in identify(clusters, events, theta).orderBy("cluster_id").collect()]


def apply(events: DataFrame, assigned: DataFrame, as_of: Column) -> DataFrame:
    """events after a run. assigned: cluster_id, event_id, centroid, n. A matched event takes the last centroid, adds the counts,
    is last seen now, and returns from the archive; a new one starts as detected."""
    last = assigned.groupBy("event_id").agg(F.max_by("centroid", "cluster_id").alias("__c"), F.sum("n").cast("int").alias("__n"))
    both = events.join(last, "event_id", "full")
    hit, old = F.col("__n").isNotNull(), F.col("status").isNotNull()
    new = {
        "centroid": F.coalesce("__c", "centroid"),
        "article_count": (F.coalesce("article_count", F.lit(0)) + F.coalesce("__n", F.lit(0))).cast("int"),
        "first_seen": F.coalesce("first_seen", as_of),
        "last_seen": F.when(hit, as_of).otherwise(F.col("last_seen")),
        "status": F.when(~old, "detected").when(hit & (F.col("status") == "archived"), "enriched").otherwise(F.col("status")),
    }
    return both.select(*[new[c].alias(c) if c in new else c for c in events.columns])


def close_unseen(registry: DataFrame, seen: DataFrame) -> DataFrame:
    """registry with every ongoing event that a run has not seen closed."""
    flagged = registry.join(seen.select("event_id").distinct().withColumn("__seen", F.lit(True)), "event_id", "left")
    return flagged.withColumn("status", F.when(F.col("__seen").isNull() & (F.col("status") == "ongoing"), "closed").otherwise(F.col("status"))).drop("__seen")


def identified(events: DataFrame, clusters: DataFrame, theta: float = THETA) -> DataFrame:
    """identify with the clusters' centroid and n. Entries of another dimension match nothing."""
    first = clusters.select(F.size("centroid").alias("k")).first()
    known = same_size(events, first.k) if first else events
    return dedup.checkpointed(identify(clusters, known, theta)).join(clusters.select("cluster_id", "centroid", "n"), "cluster_id")


def run(events: DataFrame, clusters: DataFrame, as_of: Column, theta: float = THETA) -> tuple[DataFrame, DataFrame]:
    """(registry, assigned) after the clusters of one run: cluster_id, centroid, n, first_id. Entries of another dimension stay as they are and match nothing."""
    both = identified(events, clusters, theta)
    return apply(events, both, as_of), both


def same_size(registry: DataFrame, size: int) -> DataFrame:
    """Entries whose centroid has the run's dimension; others can't be compared."""
    return registry.where(F.size("centroid") == size)
