"""Runs of the engine: registry assignment, the analysis run, incremental selection, and snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import text as T
from tidewatch.functions.vector import centroids
from tidewatch.operators import analysis, clustering, registry, serve, stats
from tidewatch.session import shared_folder
from tidewatch.sources import keyed, sinks

from .bindings import AS_OF_SQL, EVENTS_SQL, VECTORS_SQL, as_of, orders_as_events, table, vectors
from .registry import query


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    first = v.groupBy("cluster_id").agg(F.min("article_id").cast("string").alias("first_id"))
    return centroids(v, "cluster_id", "embedding").select("cluster_id", "centroid", F.col("n").cast("int").alias("n")).join(first, "cluster_id")


def _known(clusters: DataFrame) -> DataFrame:
    """A registry that knows the even clusters under their centroids, archived where the label is a multiple of four."""
    return clusters.where("cluster_id % 2 = 0").select(
        F.concat(F.lit("e"), F.col("cluster_id").cast("string")).alias("event_id"), "centroid", F.when(F.col("cluster_id") % 4 == 0, "archived").otherwise("enriched").alias("status"),
        F.lit(5).alias("article_count"), (as_of() - F.expr("interval 9 days")).alias("first_seen"), (as_of() - F.expr("interval 5 days")).alias("last_seen"),
    )


_GROUPS = """g AS (SELECT cluster_id, count(*) AS n, min(article_id) AS first_id FROM vectors_ GROUP BY 1),
 i AS (SELECT *, CASE WHEN cluster_id % 2 = 0 THEN 'e' || cluster_id ELSE left(sha256(cluster_id || '|' || first_id), 32) END AS event_id FROM g)"""


@query(f"WITH {VECTORS_SQL}, {_GROUPS} SELECT cluster_id, event_id, cluster_id % 2 <> 0 AS is_new FROM i")
def registry_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8: the clusters of a run take the identity of live events, or a new one; centroids are only near themselves at this threshold."""
    clusters = _clusters(spark, sf_dir)
    return registry.run(_known(clusters), clusters, as_of(), 0.999)[1].select("cluster_id", "event_id", "is_new")


@query(f"""WITH {VECTORS_SQL}, {_GROUPS} SELECT event_id, CASE WHEN cluster_id % 2 <> 0 THEN 'detected' ELSE 'enriched' END AS status,
 (n + CASE WHEN cluster_id % 2 = 0 THEN 5 ELSE 0 END)::INTEGER AS article_count, {AS_OF_SQL} AS last_seen FROM i""")
def registry_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry after a run; archived events that match come back."""
    clusters = _clusters(spark, sf_dir)
    return registry.run(_known(clusters), clusters, as_of(), 0.999)[0].select("event_id", "status", "article_count", "last_seen")


@query(f"WITH {VECTORS_SQL}, {_GROUPS} SELECT count(*) FILTER (WHERE cluster_id % 2 = 0) AS ongoing, count(*) FILTER (WHERE cluster_id % 2 <> 0) AS closed FROM i")
def registry_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9: entries of another dimension match nothing and are closed as unseen; those that match go on."""
    clusters = _clusters(spark, sf_dir)
    known = _known(clusters).withColumn("status", F.lit("ongoing"))
    odd = clusters.where("cluster_id % 2 <> 0").select(F.concat(F.lit("o"), F.col("cluster_id").cast("string")).alias("event_id"), F.slice("centroid", 1, 3).alias("centroid"), F.lit("ongoing").alias("status"), F.lit(1).alias("article_count"), as_of().alias("first_seen"), as_of().alias("last_seen"))
    after, assigned = registry.run(known.unionByName(odd), clusters, as_of(), 0.999)
    closed = registry.close_unseen(after, assigned)
    return closed.agg(F.count_if(F.col("status") == "ongoing").alias("ongoing"), F.count_if(F.col("status") == "closed").alias("closed"))


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as articles: some without a vector, some duplicates, some linked, taken in at the time of their event."""
    return vectors(spark, sf_dir).select(
        "article_id", F.when(F.col("article_id") % 7 != 0, F.col("embedding")).alias("embedding"), (F.col("article_id") % 11 == 0).alias("is_duplicate"),
        F.when(F.col("article_id") % 13 == 0, "known").alias("event_id"), F.col("published_at").alias("ingested_at"), "published_at", F.col("cluster_id").alias("label"),
    )


_FRESH = f"article_id % 7 <> 0 AND article_id % 11 <> 0 AND article_id % 13 <> 0 AND published_at >= {AS_OF_SQL} - INTERVAL 60 DAY"


@query(f"WITH {VECTORS_SQL} SELECT article_id FROM vectors_ WHERE article_id % 7 = 0 AND article_id % 11 <> 0")
def unembedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is still to be embedded."""
    return clustering.unembedded(_articles(spark, sf_dir)).select("article_id")


@query(f"WITH {VECTORS_SQL} SELECT article_id FROM vectors_ WHERE {_FRESH}")
def clustering_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedded, no duplicate, in no event, taken in within some days, 60 here as the tables span so many."""
    return clustering.candidates(_articles(spark, sf_dir), as_of(), 60).select("article_id")


@query(f"""WITH {VECTORS_SQL}, c AS (SELECT * FROM vectors_ WHERE {_FRESH}), k AS (SELECT cluster_id, count(*) AS n FROM c GROUP BY 1 HAVING count(*) >= 3)
 SELECT (SELECT count(*) FROM c) AS candidates, count(*) AS clusters, coalesce(sum(n), 0)::BIGINT AS linked, 0::BIGINT AS duplicates, count(*) AS new_events, 0::BIGINT AS matched_events FROM k""")
def nlp_cycle_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of an analysis run, here by given labels in place of density clusters, into an empty registry."""
    by_label = lambda df: df.select("article_id", F.col("label").alias("cluster_id"))
    events = _known(_clusters(spark, sf_dir)).where("false")
    return analysis.analyse(_articles(spark, sf_dir), events, as_of(), by_label, 60, cohesion=-1.0, duplicate=(1.5, 72), theta=0.999)[2]


@query(f"""WITH {VECTORS_SQL}, c AS (SELECT * FROM vectors_ WHERE {_FRESH}), k AS (SELECT cluster_id, min(article_id) AS first_id FROM c GROUP BY 1 HAVING count(*) >= 3)
 SELECT v.article_id, CASE WHEN c.article_id IS NOT NULL AND k.cluster_id IS NOT NULL THEN left(sha256(k.cluster_id || '|' || k.first_id), 32) WHEN v.article_id % 13 = 0 THEN 'known' END AS event_id
 FROM vectors_ v LEFT JOIN c ON c.article_id = v.article_id LEFT JOIN k ON k.cluster_id = c.cluster_id""")
def nlp_cycle_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The articles after the run."""
    by_label = lambda df: df.select("article_id", F.col("label").alias("cluster_id"))
    events = _known(_clusters(spark, sf_dir)).where("false")
    return analysis.analyse(_articles(spark, sf_dir), events, as_of(), by_label, 60, cohesion=-1.0, duplicate=(1.5, 72), theta=0.999)[0].select("article_id", "event_id")


@query("""SELECT user_id % 50 AS c, count(DISTINCT event_type) AS sources FROM events WHERE user_id % 10 <> 0 GROUP BY 1""")
def cluster_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct sources of each cluster."""
    rows = table(spark, sf_dir, "events").withColumn("c", F.when(F.col("user_id") % 10 == 0, -1).otherwise(F.col("user_id") % 50))
    return stats.cluster_sources(rows, "c", "event_type")


@query("""SELECT user_id, 'T' || min(event_id) FILTER (WHERE event_id % 3 <> 0) AS title FROM events GROUP BY 1""")
def representative_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first title that is not empty, in order of members."""
    title = F.when(F.col("event_id") % 3 == 0, " ").otherwise(F.concat(F.lit("T"), F.col("event_id").cast("string")))
    return stats.representative_titles(table(spark, sf_dir, "events").select("user_id", title.alias("title"), F.col("event_id").alias("ord")), "user_id")


@query(f"WITH {EVENTS_SQL} SELECT count(*) AS events, count(*) FILTER (WHERE channel <> '5-LOW') AS geocoded, round(avg(CASE WHEN channel <> '5-LOW' THEN 1.0 ELSE 0.0 END), 9) AS share FROM events_")
def geocoded_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with coordinates."""
    rows = orders_as_events(spark, sf_dir).withColumn("lat", F.when(F.col("channel") != "5-LOW", F.col("lat")))
    return stats.places(rows).withColumn("share", F.round("share", 9))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE ts END AS stamp FROM events""")
def iso_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: ISO 8601 stamps; what can't be read is null."""
    text = F.when(F.col("event_id") % 4 == 0, "31/12/2023").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    return table(spark, sf_dir, "events").select("event_id", T.iso_stamp(text).cast("timestamp_ntz").alias("stamp"))


@query("""SELECT user_id, list_sort(list(DISTINCT event_type)) <> [] AND list_has_all(['click', 'view', 'error'], list(DISTINCT event_type)) AS ok FROM events GROUP BY 1""")
def label_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U4: whether all labels of a row are of a domain."""
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("labels"))
    return serve.validate(rows, {}, {"labels": ["click", "view", "error"]}).select("user_id", (F.size("errors") == 0).alias("ok"))


@query("SELECT 'kept' AS step, count(*) AS n FROM events UNION ALL SELECT 'replaced', count(*) FROM events WHERE event_type = 'click' UNION ALL SELECT 'reset', 0 UNION ALL SELECT 'none', 0")
def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5, K6: snapshots written, replaced, reset and counted; a path without any is empty."""
    at, schema = f"{shared_folder(spark).rstrip('/')}/snapshot-{uuid.uuid4().hex}", "event_id long, event_type string"
    rows = table(spark, sf_dir, "events").select(F.col("event_id").cast("long").alias("event_id"), "event_type")
    out = [sinks.count(spark, at, schema).withColumn("step", F.lit("none"))]
    sinks.snapshot(rows, at)
    out.append(sinks.count(spark, at, schema).withColumn("step", F.lit("kept")))
    sinks.snapshot(sinks.load_snapshot(spark, at, schema).where("event_type = 'click'"), at)
    out.append(sinks.count(spark, at, schema).withColumn("step", F.lit("replaced")))
    sinks.reset(spark, at, schema)
    out.append(sinks.count(spark, at, schema).withColumn("step", F.lit("reset")))
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole.select("step", "n")


def _deltas(spark: SparkSession, sf_dir: str) -> keyed.KeyedTable:
    """Orders as a keyed table that is compacted and then changed: prices, ends, new rows, and prices again."""
    orders, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    out = keyed.KeyedTable(spark, f"{shared_folder(spark).rstrip('/')}/keyed-{uuid.uuid4().hex}", "o_orderkey long, o_orderstatus string, o_totalprice double, note string", "o_orderkey", 4)
    out.upsert(orders.select("o_orderkey", "o_orderstatus", "o_totalprice", F.lit("first").alias("note")))
    out.compact()
    out.update(orders.where("o_orderkey % 10 = 0").select("o_orderkey", F.lit(0.0).alias("o_totalprice")))
    out.delete(orders.where("o_orderkey % 7 = 0"))
    out.upsert(orders.where("o_orderkey % 11 = 0").select(key, F.lit(None).cast("string").alias("note")))
    out.upsert(orders.where("o_orderkey % 13 = 0").select((-1 - key).alias("o_orderkey"), "o_totalprice"))
    out.update(orders.where("o_orderkey % 26 = 0").select((-1 - key).alias("o_orderkey"), F.lit("later").alias("note")))
    return out


_DELTAS = """x AS (SELECT o_orderkey AS k, o_orderstatus AS s, CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE o_totalprice END AS p, CASE WHEN o_orderkey % 11 <> 0 THEN 'first' END AS n FROM orders WHERE o_orderkey % 7 <> 0
 UNION ALL SELECT o_orderkey, NULL, NULL, NULL FROM orders WHERE o_orderkey % 7 = 0 AND o_orderkey % 11 = 0
 UNION ALL SELECT -1 - o_orderkey, NULL, o_totalprice, CASE WHEN o_orderkey % 26 = 0 THEN 'later' END FROM orders WHERE o_orderkey % 13 = 0)"""


@query(f"WITH {_DELTAS} SELECT k AS o_orderkey, s AS o_orderstatus, p AS o_totalprice, n AS note FROM x")
def delta_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyed table read through its changes: the last value of each column, ended rows left out unless made again."""
    return _deltas(spark, sf_dir).read()


@query(f"""WITH {_DELTAS}, o AS (SELECT count(*) AS n, count(n) AS notes FROM x) SELECT step, done, n AS "rows", notes FROM o, (VALUES ('joined', 'joined'), ('small', 'none'), ('base', 'base'), ('again', 'none')) t(step, done)""")
def delta_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes joined to one, then held by a new base; the rows stay the same."""
    changes, whole = _deltas(spark, sf_dir), None
    for step, share, most in (("joined", 1e9, 2), ("small", 1e9, 2), ("base", 0.0, 2), ("again", 0.0, 2)):
        done = changes.compact(share, most) or "none"
        row = changes.read("note", version=changes.version).agg(F.count("*").alias("rows"), F.count("note").alias("notes")).select(F.lit(step).alias("step"), F.lit(done).alias("done"), "rows", "notes")
        whole = row if whole is None else whole.unionByName(row)
    return whole
