"""Counts, distributions and roll-ups over the bound tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import geo
from tidewatch.functions import text as T
from tidewatch.operators import stats

from .bindings import AS_OF_SQL, EVENTS_SQL, LAT_SQL, LON_SQL, as_of, coordinates, lines_as_articles, orders_as_events, parts_as_labelled, table
from .registry import query


@query("SELECT (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS total_events, (SELECT count(*) FROM lineitem WHERE l_returnflag <> 'R') AS total_articles")
def stats_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: filtered counts."""
    return stats.totals(orders_as_events(spark, sf_dir), lines_as_articles(spark, sf_dir))


@query("SELECT label, count(*) AS count FROM (SELECT unnest(string_split(p_name, ' ')) AS label FROM part) WHERE label <> '' GROUP BY 1")
def stats_by_label_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by each label of an array."""
    return stats.by_label(parts_as_labelled(spark, sf_dir), "labels")


@query("SELECT o_orderpriority AS label, count(*) AS count FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def stats_by_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: rows by value."""
    return stats.by_value(orders_as_events(spark, sf_dir).where("status = 'enriched'"), "channel")


@query("SELECT strftime(o_orderdate, '%Y-%m-%d') AS label, count(*) AS count FROM orders GROUP BY 1 ORDER BY 1 DESC LIMIT 90")
def stats_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: the newest 90 days that have any."""
    return stats.by_day(table(spark, sf_dir, "orders"), "o_orderdate")


@query("SELECT n_name AS label, count(*) AS count FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
def stats_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: by region, through two keys."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    rows = table(spark, sf_dir, "orders").select("o_custkey").join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return stats.by_value(rows.join(nation, F.col("c_nationkey") == F.col("n_nationkey")), "n_name")


@query("""SELECT axis, label, count(*) AS count FROM (SELECT 'labels' AS axis, unnest(string_split(p_name, ' ')) AS label FROM part UNION ALL SELECT 'brand', p_brand FROM part
 UNION ALL SELECT 'size', p_size::VARCHAR FROM part) WHERE label <> '' GROUP BY ALL""")
def stats_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: several axes in one pass."""
    return stats.document(parts_as_labelled(spark, sf_dir), {"labels": "labels", "brand": "p_brand", "size": "p_size"})


@query(f"""WITH {EVENTS_SQL} SELECT count(DISTINCT coalesce(CASE WHEN event_id % 3 = 0 THEN 'R' || region END, format('{{:.2f}}', lat) || ',' || format('{{:.2f}}', lon))) AS locations FROM events_""")
def kpi_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct regions, or coordinates at two decimals."""
    region = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("R"), F.col("region").cast("string")))
    return orders_as_events(spark, sf_dir).agg(F.count_distinct(geo.location_key(region, F.col("lat"), F.col("lon"))).alias("locations"))


@query(f"SELECT least(200, count(*)) AS recent FROM events WHERE ts >= {AS_OF_SQL} - INTERVAL 48 HOUR")
def kpi_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New ones in some hours, up to a cap."""
    return stats.recent(table(spark, sf_dir, "events"), "ts", as_of(), 48)


@query("SELECT count(*) AS total, count(DISTINCT ts::DATE) AS days, count(*)::DOUBLE / greatest(count(DISTINCT ts::DATE), 1) AS average FROM events")
def kpi_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows a day."""
    return stats.per_day(table(spark, sf_dir, "events"), "ts")


@query("SELECT coalesce(CASE WHEN event_type <> 'view' THEN event_type END, 'unknown') AS label, count(*) AS count FROM events GROUP BY 1")
def source_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: by type, unknown ones together."""
    return stats.by_value(table(spark, sf_dir, "events"), F.when(F.col("event_type") != "view", F.col("event_type")), "unknown")


_ROLL = f"""a AS (SELECT event_id AS ord, CASE WHEN user_id % 10 <> 3 THEN user_id::VARCHAR END AS event_id, event_type AS source, (event_id % 4)::INTEGER AS cluster_id,
 {LAT_SQL.format('event_id')} AS lat, {LON_SQL.format('event_id')} AS lon, CASE WHEN event_id % 3 = 0 THEN event_type END AS country, CASE WHEN event_id % 5 = 4 THEN props ELSE '' END AS summary, 'T' || event_id AS title FROM events)"""


def _rolled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumns(coordinates("event_id"))
    return stats.roll_up(rows.select(
        F.col("event_id").alias("ord"), F.col("event_id").cast("string").alias("article_id"), F.when(F.col("user_id") % 10 != 3, F.col("user_id").cast("string")).alias("event_id"),
        F.col("event_type").alias("source"), (F.col("event_id") % 4).cast("int").alias("cluster_id"), "lat", "lon", F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("country"),
        F.when(F.col("event_id") % 5 == 4, F.col("props")).otherwise("").alias("summary"), F.concat(F.lit("T"), F.col("event_id").cast("string")).alias("title"),
    ))


@query(f"""WITH {_ROLL}, g AS (SELECT event_id, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon, count(*) AS article_count, array_to_string(list_sort(list(DISTINCT source)), '|') AS sources,
 string_agg(ord::VARCHAR, ',' ORDER BY ord) AS articles FROM a WHERE event_id IS NOT NULL GROUP BY 1),
 r AS (SELECT event_id, title, summary FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY summary = '', ord) AS k FROM a WHERE event_id IS NOT NULL) WHERE k = 1),
 c AS (SELECT event_id, country FROM (SELECT event_id, country, row_number() OVER (PARTITION BY event_id ORDER BY count(*) DESC, min(ord)) AS k FROM a WHERE event_id IS NOT NULL AND country IS NOT NULL GROUP BY 1, 2) WHERE k = 1),
 d AS (SELECT event_id, cluster_id FROM (SELECT event_id, cluster_id, row_number() OVER (PARTITION BY event_id ORDER BY count(*) DESC, min(ord)) AS k FROM a WHERE event_id IS NOT NULL GROUP BY 1, 2) WHERE k = 1)
 SELECT g.*, r.title, r.summary, c.country, d.cluster_id FROM g JOIN r USING (event_id) LEFT JOIN c USING (event_id) LEFT JOIN d USING (event_id)""")
def event_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles to events, with modes and a representative."""
    return _rolled(spark, sf_dir).select(
        "event_id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "article_count", F.array_join("sources", "|").alias("sources"),
        F.array_join("articles", ",").alias("articles"), "title", "summary", "country", "cluster_id",
    )


@query(f"""WITH {_ROLL}, e AS (SELECT DISTINCT event_id FROM a WHERE event_id IS NOT NULL), x AS (SELECT event_id, unnest([0, 1, 2]) AS k FROM e)
 SELECT CASE WHEN k = 0 THEN event_id ELSE event_id || '-' || (k + 1) END AS event_id, CASE WHEN k > 0 THEN k * 1.5::DOUBLE END AS lat FROM x""")
def sub_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Further places of an event as rows `<id>-2`, `<id>-3`."""
    rows = _rolled(spark, sf_dir).select("event_id", F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"))
    extra = F.from_json(F.lit('[{"lat": 1.5, "lon": 2}, {"lat": 3.0, "lon": 4}]'), "array<struct<lat:double,lon:double>>")
    return stats.with_sub_events(rows.withColumn("extra", extra), "extra").select("event_id", "lat")


@query("""WITH f AS (SELECT user_id, arg_min(event_type, event_id) AS category, min(event_id) AS first_id, min(ts) AS first_ts FROM events GROUP BY 1),
 c AS (SELECT 'category' AS axis, category AS label, count(*) AS count FROM f GROUP BY 2),
 d AS (SELECT 'date' AS axis, left(strftime(first_ts, '%Y-%m-%d %H'), 10) AS label, count(*) AS count FROM f GROUP BY 2)
 SELECT * FROM c UNION ALL SELECT * FROM d UNION ALL SELECT 'total', 'events', count(*) FROM f""")
def legacy_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of each event counts, by category and by date."""
    first = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("category"), F.min("ts").alias("first_ts"))
    day = F.left(F.date_format("first_ts", "yyyy-MM-dd HH"), F.lit(10))
    numbered = T.strip_numbering(F.concat(F.lit("3. "), F.col("category")))
    axes = {"category": numbered, "date": F.when(F.length(day) == 10, day), "total": F.lit("events")}
    rows = first.select(F.explode(F.create_map(*[x for k, v in axes.items() for x in (F.lit(k), v)])).alias("axis", "label"))
    return rows.where("label is not null").groupBy("axis", "label").agg(F.count("*").alias("count"))


@query("""SELECT count(*) AS fetched, count(*) FILTER (WHERE event_type = 'click') AS relevant, count(*) FILTER (WHERE event_type = 'click' AND value > 10) AS inserted FROM events""")
def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a run in one pass."""
    click = F.col("event_type") == "click"
    return stats.metrics(table(spark, sf_dir, "events"), fetched=F.lit(True), relevant=click, inserted=click & (F.col("value") > 10))


@query("""WITH c AS (SELECT *, CASE WHEN user_id % 10 = 0 THEN -1 ELSE user_id % 50 END AS c FROM events), s AS (SELECT c, count(*) AS n FROM c WHERE c <> -1 GROUP BY 1)
 SELECT (SELECT count(*) FROM s) AS clusters, (SELECT median(n)::DOUBLE FROM s) AS median_size, (SELECT max(n) FROM s) AS max_size, avg((c = -1)::INTEGER)::DOUBLE AS noise_share,
 count(*) FILTER (WHERE value < 1) AS duplicates, count(DISTINCT event_type) AS sources FROM c""")
def cluster_size_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes, noise and duplicates."""
    rows = table(spark, sf_dir, "events").withColumn("c", F.when(F.col("user_id") % 10 == 0, -1).otherwise(F.col("user_id") % 50))
    return stats.cluster_sizes(rows, "c", "event_type", F.col("value") < 1)


@query("""WITH s AS (SELECT user_id % 50 AS c, count(*) AS n FROM events WHERE user_id % 50 <> 49 GROUP BY 1), e AS (SELECT min(n) AS lo, max(n) AS hi, greatest(10, count(*) // 5) AS bins FROM s)
 SELECT (CASE WHEN hi = lo THEN 0 ELSE least(bins - 1, floor((n - lo) * bins / (hi - lo)::DOUBLE)) END)::INTEGER AS bin, count(*) AS clusters FROM s, e GROUP BY 1""")
def cluster_size_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters by size."""
    rows = table(spark, sf_dir, "events").withColumn("c", F.when(F.col("user_id") % 50 == 49, -1).otherwise(F.col("user_id") % 50))
    return stats.size_histogram(rows, "c")


@query("""SELECT count(*) FILTER (WHERE user_id % 10 <> 0 AND value >= 1) AS clustered, count(*) FILTER (WHERE user_id % 10 = 0 AND value >= 1) AS noise, count(*) FILTER (WHERE value < 1) AS duplicates,
 round(100.0 * count(*) FILTER (WHERE value < 1) / count(*), 6) AS duplicate_percent FROM events""")
def record_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clustered, noise and duplicate records."""
    dup, noise = F.col("value") < 1, F.col("user_id") % 10 == 0
    rows = stats.metrics(table(spark, sf_dir, "events"), clustered=~noise & ~dup, noise=noise & ~dup, duplicates=dup, total=F.lit(True))
    return rows.select("clustered", "noise", "duplicates", F.round(100.0 * F.col("duplicates") / F.col("total"), 6).alias("duplicate_percent"))


@query("SELECT label AS cluster, string_agg(vec_id::VARCHAR, ',' ORDER BY vec_id) AS members FROM embeddings GROUP BY 1")
def cluster_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The members of each cluster."""
    rows = stats.members(table(spark, sf_dir, "embeddings"), "label", "vec_id")
    return rows.select(F.col("label").alias("cluster"), F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))
