"""Read path: event lists, details, reports, search, GeoJSON and look-ups."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import geo, moments
from tidewatch.functions import text as T
from tidewatch.operators import classify, lookups, serve, stats
from tidewatch.session import shared_folder
from tidewatch.sources import config, feeds, sinks

from .bindings import ARTICLES_SQL, AS_OF_SQL, EVENTS_SQL, LAT_SQL, LON_SQL, as_of, coordinates, lines_as_articles, orders_as_events, parts_as_labelled, table
from .registry import query

_LIST = ["event_id", "status", "channel", "first_seen", "last_seen"]


@query(f"""WITH {EVENTS_SQL} SELECT event_id, status, channel, first_seen, last_seen FROM events_
 WHERE status = 'enriched' AND channel = '1-URGENT' AND first_seen >= TIMESTAMP '1995-01-01' AND last_seen <= TIMESTAMP '1998-12-31'
 ORDER BY last_seen DESC NULLS LAST, event_id LIMIT 50""")
def list_events_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enriched events of a channel in a time range, a page."""
    rows = serve.list_events(orders_as_events(spark, sf_dir), channel="1-URGENT", date_from="1995-01-01", date_to="1998-12-31")
    return rows.select(*_LIST)


@query(f"""WITH {EVENTS_SQL} SELECT event_id, status, channel, first_seen, last_seen FROM events_ WHERE status = 'enriched'
 ORDER BY last_seen DESC NULLS LAST, event_id LIMIT 40 OFFSET 30""")
def list_events_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1: limit and offset, unknown activity last."""
    return serve.list_events(orders_as_events(spark, sf_dir), limit=40, offset=30).select(*_LIST)


@query(f"""WITH {EVENTS_SQL} SELECT event_id, round(lat, 6) AS lat, round(lon, 6) AS lon FROM events_
 WHERE status = 'enriched' AND lon BETWEEN 22 AND 24.5 AND lat BETWEEN 37 AND 38.5 ORDER BY last_seen DESC NULLS LAST, event_id LIMIT 1000""")
def events_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in a box, capped for a map."""
    rows = serve.list_events(orders_as_events(spark, sf_dir), bbox="22,37,24.5,38.5", limit=1000)
    return rows.select("event_id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query("""SELECT p_partkey, array_to_string(string_split(p_name, ' '), '|') AS labels, p_type FROM part
 WHERE list_has_any(string_split(p_name, ' '), ['red', 'ring']) AND p_type IN ('ECONOMY', 'STANDARD')""")
def events_multi_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any value within an axis, all axes together."""
    rows = serve.multi_select(parts_as_labelled(spark, sf_dir), {"labels": ["red", "ring"]}, {"p_type": ["ECONOMY", "STANDARD"]})
    return rows.select("p_partkey", F.array_join("labels", "|").alias("labels"), "p_type")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'license')")
def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case-blind substring."""
    return serve.search(table(spark, sf_dir, "documents"), " License ", "text").select("doc_id")


@query(f"SELECT event_type, count(*) AS n FROM events WHERE ts >= {AS_OF_SQL} - INTERVAL 7 DAY GROUP BY 1")
def time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last seven days."""
    return serve.since(table(spark, sf_dir, "events"), "ts", "7d", as_of()).groupBy("event_type").agg(F.count("*").alias("n"))


@query(f"""WITH {EVENTS_SQL}, {ARTICLES_SQL}, top AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY published_at DESC NULLS FIRST, article_id) AS rank
 FROM articles_ WHERE NOT is_duplicate), nested AS (SELECT event_id, string_agg(article_id, ',' ORDER BY rank) AS articles, count(*) AS n_articles FROM top WHERE rank <= 3 GROUP BY 1)
 SELECT e.event_id, e.status, n.articles, coalesce(n.n_articles, 0) AS n_articles FROM events_ e LEFT JOIN nested n ON n.event_id = e.event_id""")
def event_detail_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event with its newest articles, undated first."""
    rows = serve.event_detail(orders_as_events(spark, sf_dir), lines_as_articles(spark, sf_dir).withColumn("title", F.lit("")), 3)
    ids = F.array_join(F.transform("articles", lambda a: a["article_id"]), ",")
    return rows.select("event_id", "status", ids.alias("articles"), F.coalesce(F.size("articles"), F.lit(0)).cast("long").alias("n_articles"))


@query(f"""WITH {EVENTS_SQL}, {ARTICLES_SQL}, c AS (SELECT event_id, count(*) AS article_count FROM articles_ GROUP BY 1)
 SELECT left(e.event_id::VARCHAR, 8) AS cluster_id, c.article_count, e.status, a.article_id, a.published_at FROM events_ e JOIN c ON c.event_id = e.event_id
 JOIN articles_ a ON a.event_id = e.event_id AND NOT a.is_duplicate""")
def event_articles_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line for each canonical article."""
    articles = lines_as_articles(spark, sf_dir)
    counts = articles.groupBy("event_id").agg(F.count("*").alias("article_count"))
    events = orders_as_events(spark, sf_dir).join(counts, "event_id").withColumn("event_id", F.col("event_id").cast("string"))
    rows = serve.report(events, articles.withColumn("event_id", F.col("event_id").cast("string")))
    return rows.select("cluster_id", "article_count", "status", "article_id", "published_at")


@query(f"""WITH {EVENTS_SQL} SELECT event_id, status, first_seen FROM events_ WHERE status = 'pending_review' ORDER BY first_seen DESC NULLS LAST, event_id LIMIT 50""")
def admin_event_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The moderation queue."""
    return serve.admin_events(orders_as_events(spark, sf_dir), status="pending_review").select("event_id", "status", "first_seen")


@query(f"""WITH {EVENTS_SQL}, {ARTICLES_SQL}, n AS (SELECT event_id, string_agg(article_id, ',' ORDER BY article_id) AS articles FROM articles_ GROUP BY 1),
 l AS (SELECT n_nationkey AS event_id, n_name AS location_name FROM nation)
 SELECT e.event_id, l.location_name AS locations, n.articles FROM events_ e LEFT JOIN n ON n.event_id = e.event_id LEFT JOIN l ON l.event_id = e.event_id""")
def admin_event_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event with its places and all its articles."""
    places = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("event_id"), F.col("n_nationkey").alias("location_id"), F.col("n_name").alias("location_name"), F.lit(True).alias("is_primary"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"))
    rows = serve.admin_detail(orders_as_events(spark, sf_dir), places, lines_as_articles(spark, sf_dir).withColumn("title", F.lit("")))
    name, ids = F.transform("locations", lambda x: x["location_name"]), F.transform("articles", lambda x: x["article_id"])
    return rows.select("event_id", F.array_join(name, ",").alias("locations"), F.array_join(ids, ",").alias("articles"))


@query(f"""WITH {EVENTS_SQL} SELECT event_id, round(lat, 2) AS lat, round(lon, 2) AS lon, 'Feature' AS kind, 'Point' AS shape, status FROM events_ WHERE event_id % 5 <> 0""")
def geojson_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GeoJSON features of events with coordinates, read back."""
    rows = orders_as_events(spark, sf_dir).withColumn("lat", F.when(F.col("event_id") % 5 != 0, F.col("lat")))
    found = sinks.features(rows, ["event_id", "status"])
    body = F.from_json("feature", "type string, geometry struct<type:string,coordinates:array<double>>, properties struct<event_id:long,status:string>")
    found = found.select(body.alias("f"))
    return found.select(
        F.col("f.properties.event_id").alias("event_id"), F.round(F.col("f.geometry.coordinates")[1], 2).alias("lat"), F.round(F.col("f.geometry.coordinates")[0], 2).alias("lon"),
        F.col("f.type").alias("kind"), F.col("f.geometry.type").alias("shape"), F.col("f.properties.status").alias("status"),
    )


@query("""SELECT p_partkey, CASE WHEN contains(lower(p_name), 'ring') THEN 'Ring' WHEN contains(lower(p_name), 'red') THEN 'Red' WHEN contains(lower(p_name), 'small') THEN 'Small' END AS place,
 CASE WHEN contains(lower(p_name), 'ring') THEN 1.5 WHEN contains(lower(p_name), 'red') THEN 2.5 WHEN contains(lower(p_name), 'small') THEN 3.5 END AS lat FROM part""")
def gazetteer_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first name in file order that a text contains."""
    names = spark.createDataFrame([(0, "ring", 1.5, 0.0), (1, "red", 2.5, 0.0), (2, "small", 3.5, 0.0)], "ord int, name string, lat double, lon double")
    return lookups.first_in_text(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", names).select("p_partkey", "place", "lat")


@query("""WITH n AS (SELECT doc_id AS ord, regexp_extract(lower(text), '[a-z]{6,}', 0) AS name FROM documents WHERE regexp_extract(lower(text), '[a-z]{6,}', 0) <> '' UNION ALL SELECT 10000000 + c_custkey, lower(c_name) FROM customer),
 f AS (SELECT name, min(ord) AS ord FROM n GROUP BY 1), h AS (SELECT d.doc_id, min(f.ord) AS ord FROM documents d JOIN f ON contains(lower(d.text), f.name) GROUP BY 1)
 SELECT doc_id, name AS place, h.ord::DOUBLE AS lat FROM documents LEFT JOIN h USING (doc_id) LEFT JOIN f ON f.ord = h.ord""")
def gazetteer_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of many names, of all documents and customers, that a text contains."""
    docs, customers = table(spark, sf_dir, "documents"), table(spark, sf_dir, "customer")
    first = F.regexp_extract(F.lower("text"), "[a-z]{6,}", 0)
    names = docs.select(F.col("doc_id").cast("long").alias("ord"), first.alias("name")).where("name <> ''").union(customers.select((F.col("c_custkey") + 10000000).cast("long"), F.lower("c_name")))
    names = names.withColumns({"lat": F.col("ord").cast("double"), "lon": F.lit(0.0)})
    return lookups.first_in_text(docs.select("doc_id", "text"), "text", names).select("doc_id", F.lower("place").alias("place"), "lat")


def _code_case(column: str) -> str:
    whens = lambda n: " ".join(f"WHEN left({column}, {n}) = '{k}' THEN '{v}'" for k, v in feeds.EVENT_CATEGORY.items() if len(k) == n)
    same = " ".join(f"WHEN {column} = '{k}' THEN '{v}'" for k, v in feeds.EVENT_CATEGORY.items())
    return f"CASE {same} {whens(3)} {whens(2)} ELSE 'conflict' END"


@query(f"""WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, (1400 + l_partkey % 600)::VARCHAR AS code FROM lineitem)
 SELECT code, {_code_case('code')} AS category, count(*) AS n FROM c GROUP BY ALL""")
def code_prefix_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event codes with fallback to shorter prefixes."""
    code = (1400 + F.col("l_partkey") % 600).cast("string")
    rows = table(spark, sf_dir, "lineitem").select(code.alias("code"))
    return rows.groupBy("code", lookups.coded(F.col("code"), feeds.EVENT_CATEGORY, "conflict").alias("category")).agg(F.count("*").alias("n"))


@query("""SELECT event_id, CASE WHEN event_type = 'click' AND user_id % 2 = 0 THEN 'even click' WHEN event_type = 'click' THEN 'click' WHEN event_type = 'view' THEN 'look' ELSE 'other' END AS category FROM events""")
def pair_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pair, then single, then default."""
    sub = F.when(F.col("user_id") % 2 == 0, " EVEN ").otherwise("odd")
    got = lookups.paired(F.upper("event_type"), sub, {("click", "even"): "even click"}, {"click": "click", "view": "look"}, "other")
    return table(spark, sf_dir, "events").select("event_id", got.alias("category"))


@query(f"""SELECT p_partkey, {' '.join(['CASE p_size % 4'] + [f"WHEN {i} THEN '{classify.ENGLISH[x]}'" for i, x in enumerate(classify.INTENSITIES)] + ["ELSE 'unknown' END"])} AS label,
 CASE WHEN p_size % 4 < 3 THEN (p_size % 4 + 1)::INTEGER END AS level FROM part""")
def taxonomy_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels in the other language, and the level of an intensity; unknown values stay."""
    value = F.get(F.array(*map(F.lit, [*classify.INTENSITIES, "unknown"])), F.col("p_size") % 4)
    rows = table(spark, sf_dir, "part").select("p_partkey", value.alias("v"))
    return rows.select("p_partkey", lookups.translated(F.col("v"), classify.ENGLISH).alias("label"), classify.level(F.col("v")).alias("level"))


_RINGS = [[[(20.0, 35.0), (26.0, 35.5), (25.0, 40.0), (21.0, 41.0), (20.0, 35.0)], [(22.5, 37.0), (23.5, 37.0), (23.5, 38.0), (22.5, 38.0), (22.5, 37.0)]]]
_SIDES = ", ".join(f"({a[0]}, {a[1]}, {b[0]}, {b[1]})" for p in _RINGS for r in p for a, b in zip(r, r[1:], strict=False))


@query(f"""WITH s(ax, ay, bx, byy) AS (VALUES {_SIDES}), p AS (SELECT o_orderkey, {LAT_SQL.format('o_orderkey')} AS lat, {LON_SQL.format('o_orderkey')} AS lon FROM orders),
 d AS (SELECT o_orderkey, lat, lon, ax, ay, bx, byy, least(1.0, greatest(0.0, ((lon - ax) * (bx - ax) + (lat - ay) * (byy - ay)) / ((bx - ax) * (bx - ax) + (byy - ay) * (byy - ay)))) AS t FROM p, s)
 SELECT o_orderkey, (sum(CASE WHEN (ay > lat) <> (byy > lat) AND lon < (bx - ax) * (lat - ay) / (byy - ay) + ax THEN 1 ELSE 0 END) % 2 = 1
 OR min(sqrt(pow(lon - ax - t * (bx - ax), 2) + pow(lat - ay - t * (byy - ay), 2))) < 5.0 / 111.0) AS inside FROM d GROUP BY 1""")
def polygon_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in a polygon with a hole, or within a buffer of its border."""
    rings = F.array(*[F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in r]) for p in _RINGS for r in p])
    rows = table(spark, sf_dir, "orders").select("o_orderkey", *[c.alias(k) for k, c in coordinates("o_orderkey").items()])
    return rows.select("o_orderkey", geo.within(F.col("lat"), F.col("lon"), geo.edges(rings)).alias("inside"))


@query(f"""WITH n AS (SELECT n_nationkey, {LAT_SQL.format('n_nationkey')} AS y, {LON_SQL.format('n_nationkey')} AS x, 0.4 + n_nationkey % 3 * 0.3 AS h FROM nation), p AS (SELECT o_orderkey, {LAT_SQL.format('o_orderkey')} AS lat, {LON_SQL.format('o_orderkey')} AS lon FROM orders),
 d AS (SELECT o_orderkey, h, n_nationkey % 2 = 0 AS hole, abs(lon - x) AS a, abs(lat - y) AS b FROM p, n), b AS (SELECT 5.0 / 111.0 AS b0)
 SELECT o_orderkey, bool_or(sqrt(pow(greatest(a - h, 0), 2) + pow(greatest(b - h, 0), 2)) < b0 AND NOT (hole AND h / 2 - greatest(a, b) >= b0)) AS inside FROM d, b GROUP BY 1""")
def territory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in the union of features that overlap and have holes, as read from GeoJSON: a square around each nation, every second with a hole."""
    n = F.col("n_nationkey")
    rows = table(spark, sf_dir, "nation").withColumns(coordinates("n_nationkey")).withColumn("h", 0.4 + n % 3 * 0.3)
    ring = lambda h: F.array(*[F.array(F.col("lon") + sx * h, F.col("lat") + sy * h) for sx, sy in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))])
    rings = F.when(n % 2 == 0, F.array(ring(F.col("h")), ring(F.col("h") / 2))).otherwise(F.array(ring(F.col("h"))))
    path = f"{shared_folder(spark).rstrip('/')}/features-{uuid.uuid4().hex}"
    sinks.export_json(rows.select(F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), rings.alias("coordinates")).alias("geometry")), path)
    points = table(spark, sf_dir, "orders").select("o_orderkey", *[c.alias(k) for k, c in coordinates("o_orderkey").items()])
    return points.select("o_orderkey", geo.Territory(config.features(spark, path)).contains(F.col("lat"), F.col("lon")).alias("inside"))


@query(f"""WITH e AS (SELECT event_id, ts, date_diff('microsecond', {AS_OF_SQL}, ts) / 1e6 AS s FROM events)
 SELECT event_id, CASE WHEN abs(s) >= 2592000 THEN floor(s / 2592000 + 0.5) WHEN abs(s) >= 86400 THEN floor(s / 86400 + 0.5) WHEN abs(s) >= 3600 THEN floor(s / 3600 + 0.5) ELSE floor(s / 60 + 0.5) END::BIGINT AS amount,
 CASE WHEN abs(s) >= 2592000 THEN 'month' WHEN abs(s) >= 86400 THEN 'day' WHEN abs(s) >= 3600 THEN 'hour' ELSE 'minute' END AS unit FROM e""")
def relative_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """relative time in its largest unit."""
    rows = table(spark, sf_dir, "events").select("event_id", moments.relative(F.col("ts"), as_of()).alias("r"))
    return rows.select("event_id", "r.amount", "r.unit")


@query("SELECT p_partkey, least(64.0, greatest(24.0, 16 + sqrt(p_size) * 10)) AS bubble, least(100, round(100.0 * p_size / 40))::BIGINT AS percent, format('{:.2f}', p_retailprice / 7.0) AS shown FROM part")
def display_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bubble size, progress, fixed decimals."""
    percent = F.least(F.lit(100), F.round(100 * F.col("p_size") / 40)).cast("long")
    return table(spark, sf_dir, "part").select("p_partkey", geo.bubble_size(F.col("p_size")).alias("bubble"), percent.alias("percent"), T.fixed2(F.col("p_retailprice") / 7.0).alias("shown"))


@query("""SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 'Invalid o_orderpriority.' END, CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'Invalid o_orderstatus.' END], lambda x: x IS NOT NULL), ' ') AS errors FROM orders""")
def validate_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain checks as a list of messages."""
    rows = serve.validate(table(spark, sf_dir, "orders"), {"o_orderpriority": ["1-URGENT", "2-HIGH"], "o_orderstatus": ["F", "O"]}, {})
    return rows.select("o_orderkey", F.array_join("errors", " ").alias("errors"))


@query("""SELECT 'engine' AS name, 'ok' AS status UNION ALL SELECT 'orders', CASE WHEN count(*) > 0 THEN 'ok' ELSE 'empty' END FROM orders
 UNION ALL SELECT 'lineitem', CASE WHEN count(*) > 0 THEN 'ok' ELSE 'empty' END FROM lineitem UNION ALL SELECT 'late', CASE WHEN count(*) > 0 THEN 'ok' ELSE 'empty' END FROM orders WHERE o_orderdate > DATE '2100-01-01'""")
def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """whether the engine and its tables answer, a row each."""
    orders = table(spark, sf_dir, "orders")
    return config.health(spark, orders=orders, lineitem=table(spark, sf_dir, "lineitem"), late=orders.where("o_orderdate > '2100-01-01'"))


@query(f"""WITH {EVENTS_SQL}, n AS (SELECT *, row_number() OVER (ORDER BY last_seen DESC NULLS LAST, event_id) AS r FROM events_)
 SELECT r::BIGINT AS rank, event_id, ((r - 1) // 5)::BIGINT AS page FROM n WHERE r <= 20""")
def evidence_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of five of the first rows."""
    top = serve.page(orders_as_events(spark, sf_dir), "last_seen", 20)
    from pyspark.sql import Window

    rank = F.row_number().over(Window.orderBy(F.desc_nulls_last("last_seen"), "event_id")).cast("long")  # twenty rows
    return top.select(rank.alias("rank"), "event_id").withColumn("page", F.floor((F.col("rank") - 1) / 5).cast("long"))


@query("""SELECT o_orderkey, CASE WHEN o_totalprice / 500000 > 0.55 THEN 'high' WHEN o_totalprice / 500000 > 0.40 THEN 'medium' ELSE 'low' END AS bucket FROM orders""")
def confidence_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """strict bounds."""
    return table(spark, sf_dir, "orders").select("o_orderkey", T.confidence_bucket(F.col("o_totalprice") / 500000).alias("bucket"))


@query("SELECT o_orderstatus AS label, count(*) AS count, greatest(3.0, count(*)::DOUBLE / max(count(*)) OVER () * 100.0) AS bar FROM orders GROUP BY 1")
def share_of_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars by share of the largest."""
    return stats.share_of_max(stats.by_value(table(spark, sf_dir, "orders"), "o_orderstatus"))


@query("""SELECT c_custkey, c_mktsegment FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_mktsegment = 'MACHINERY' AND lower(n_name) = 'nation_1'""")
def category_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P20: category exactly, country without case."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("country"))
    rows = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).withColumn("category", F.col("c_mktsegment"))
    return serve.by_category(rows, "MACHINERY", "Nation_1").select("c_custkey", "c_mktsegment")


@query("""SELECT event_id, article_id FROM (SELECT source AS event_id, doc_id AS article_id, row_number() OVER (PARTITION BY source ORDER BY lang <> 'en', -length(text), doc_id) AS k FROM documents) WHERE k = 1""")
def fullest_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest text among canonical articles."""
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("event_id"), F.col("doc_id").alias("article_id"), (F.col("lang") != "en").alias("is_duplicate"), F.col("text").alias("body_text"))
    return serve.fullest(rows)


@query(f"""WITH c AS (SELECT o_custkey AS k, o_orderkey AS ord, o_orderpriority AS kind, {LAT_SQL.format('o_orderkey')} AS lat FROM orders)
 SELECT k AS place, ord, kind FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ord) AS n FROM c WHERE kind IN ('1-URGENT', '2-HIGH') AND lat < 38) WHERE n = 1""")
def accepted_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first candidate of an accepted kind inside a territory."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("place"), F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("kind"), coordinates("o_orderkey")["lat"].alias("lat"))
    return classify.first_accepted(rows, "place", ["1-URGENT", "2-HIGH"], F.col("lat") < 38).select("place", "ord", "kind")
