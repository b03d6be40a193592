"""Sources and writers over files that the query writes itself from the supplied tables, to the shared folder."""

from __future__ import annotations

import os
import pathlib
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.operators import lookups
from tidewatch.session import shared_folder
from tidewatch.sources import config, exports, feeds, schemas, sinks
from tidewatch.streaming import cycle

from .bindings import table
from .registry import query


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("""SELECT 'https://p/' || p_partkey AS url, p_name AS title, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE 'Other' END AS source,
 CASE WHEN p_size % 3 <> 0 THEN TIMESTAMP '2024-06-03 10:20:30' END AS published_at FROM part WHERE p_size % 5 <> 0""")
def rss_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of RSS files: link or guid, title without its source, dates; items with neither address are dropped."""
    at = _folder(spark, "rss")
    brand = F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise("Other")
    address = F.concat(F.lit("https://p/"), F.col("p_partkey").cast("string"))
    rows = table(spark, sf_dir, "part").select(
        F.concat("p_name", F.lit(" - "), brand).alias("title"), F.when((F.col("p_size") % 5 != 0) & (F.col("p_size") % 4 != 0), address).alias("link"),
        F.when((F.col("p_size") % 5 != 0) & (F.col("p_size") % 4 == 0), address).alias("guid"), F.when(F.col("p_size") % 3 != 0, "Mon, 03 Jun 2024 10:20:30 +0200").alias("pubDate"),
        F.struct(brand.alias("_VALUE"), F.lit("https://s").alias("_url")).alias("source"),
    )
    rows.write.format("xml").option("rootTag", "rss").option("rowTag", "item").save(at)
    return feeds.rss_items(spark, at).withColumn("published_at", F.col("published_at").cast("timestamp_ntz"))


@query("""SELECT 'u' || doc_id AS url, left(sha256('u' || doc_id), 32) AS id, source FROM documents WHERE doc_id % 3 <> 0""")
def ndjson_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of line files by source and day: those without title and body, broken lines and later copies are left out."""
    at = _folder(spark, "raw")
    some = F.col("doc_id") % 3 != 0
    rows = table(spark, sf_dir, "documents").select(
        F.coalesce("source", F.lit("")).alias("source"), F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("url"), F.when(some, "a title").otherwise(" ").alias("title"),
        F.lit("2024-06-03T10:00:00").alias("scraped_at"),
    )
    sinks.archive(rows.withColumn("by", F.col("source")), at, "by")
    sinks.archive(rows.where("url like '%1'").withColumn("by", F.col("source")), at, "by")
    spark.range(3).selectExpr("'{broken' as value").write.text(f"{at}/by=broken/dt=2024-06-04")
    return feeds.raw_records(spark, at).select("url", "id", "source")


_CODES = "CASE o_orderkey % 4 WHEN 0 THEN '1413' WHEN 1 THEN '145' WHEN 2 THEN '1899' ELSE '999' END"


@query(f"""SELECT o_orderkey::VARCHAR AS event_id, 'https://o/' || o_orderkey AS url, DATE '2024-06-03' AS published_on, CASE o_orderkey % 4 WHEN 0 THEN 'labor_economic' WHEN 1 THEN 'mass_mobilization' ELSE 'conflict' END AS category_hint,
 CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderkey / 8.0::DOUBLE END AS lat FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 9 <> 0""")
def export_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tab-separated exports: short lines, other countries and other root codes are dropped; first of each id; codes by prefix."""
    at = _folder(spark, "export")
    key = F.col("o_orderkey")
    code = F.element_at(F.array(*map(F.lit, ("1413", "145", "1899", "999"))), (key % 4 + 1).cast("int"))
    values = {
        0: key.cast("string"), 1: F.lit("20240603"), 26: code, 28: F.when(key % 9 == 0, "05").otherwise("14"), 53: F.when(key % 7 == 0, "FR").otherwise("GR"),
        56: F.when(key % 6 == 0, "x").otherwise((key / 8.0).cast("string")), 60: F.concat(F.lit("https://o/"), key.cast("string")),
    }
    line = F.concat_ws("\t", *[values.get(i, F.lit("")) for i in range(feeds.EXPORT_COLUMNS)])
    rows = table(spark, sf_dir, "orders").select(F.when(key % 5 == 0, F.concat_ws("\t", key.cast("string"), F.lit("short"))).otherwise(line).alias("value"))
    rows.union(rows.where("value like '1%'")).write.text(at)
    return feeds.event_exports(spark, at).select("event_id", "url", "published_on", "category_hint", "lat")


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderkey % 8 AS q FROM orders WHERE o_orderkey % 9 <> 0 AND o_orderkey % 8 <> 5), l AS (SELECT k, q FROM o UNION ALL SELECT k, q + 1 FROM o WHERE k % 10 = 0 AND q < 7)
 SELECT k::VARCHAR AS event_id, strftime(TIMESTAMP '2024-06-03 00:00:00' + INTERVAL 15 MINUTE * min(q), '%Y%m%d%H%M%S') AS first_file, (SELECT count(*) FROM l) AS lines FROM l GROUP BY k""")
def export_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarter-hourly exports as a stream, stopped in the middle and begun again; some hours have no file, and events stand in two."""
    at, run = _folder(spark, "quarters"), _folder(spark, "quarters-run")
    key = F.col("o_orderkey")
    values = {0: key.cast("string"), 26: F.lit("1413"), 28: F.when(key % 9 == 0, "05").otherwise("14"), 53: F.lit("GR")}
    line = F.concat_ws("\t", *[values.get(i, F.lit("")) for i in range(feeds.EXPORT_COLUMNS)])
    quarter = lambda q: F.date_format(F.lit(datetime(2024, 6, 3)).cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), (15 * q).cast("int"), F.lit(0)), "yyyyMMddHHmmss")
    rows = table(spark, sf_dir, "orders").select(key, (key % 8).alias("q"), line.alias("value")).where("q <> 5")
    rows = rows.union(rows.where("o_orderkey % 10 = 0 and q < 7").withColumn("q", F.col("q") + 1))
    written = rows.select(quarter(F.col("q")).alias("stamp"), "value").repartition(8, "stamp")
    written.write.partitionBy("stamp").text(at)

    def fetch(stamp: str) -> bytes | None:
        folder = f"{at.removeprefix('file:')}/stamp={stamp}"
        parts = sorted(f for f in os.listdir(folder) if f.startswith("part-")) if os.path.isdir(folder) else []
        return b"".join(pathlib.Path(folder, f).read_bytes() for f in parts) if parts else None

    spark.dataSource.register(exports.export_source("quarter_exports", fetch))
    for until in ("20240603003000", "20240603003000", "20240603014500"):  # the second finds nothing new
        lines = cycle.run_to(exports.stream(spark, "quarter_exports", "20240602234500", until), f"{run}/table", f"{run}/checkpoint")
    own = lines.withColumn("event_id", F.split("value", "\t")[0]).groupBy("event_id").agg(F.min("file").alias("first_file"))
    total = lines.where("split(value, '\t')[28] = '14'").agg(F.count("*").alias("lines"))
    return exports.records(lines).select("event_id").join(own, "event_id").join(F.broadcast(total)).select("event_id", "first_file", "lines")  # one row


@query("""SELECT 'https://c/' || c_custkey AS url, c_name AS title, c_mktsegment AS domain, TIMESTAMP '2024-06-03 10:20:30' AS published_at FROM customer WHERE c_custkey % 4 <> 0""")
def article_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of JSON replies; those without an address and later copies are dropped."""
    at = _folder(spark, "lists")
    url = F.when(F.col("c_custkey") % 4 == 0, " ").otherwise(F.concat(F.lit("https://c/"), F.col("c_custkey").cast("string")))
    one = F.struct(url.alias("url"), F.concat(F.lit("  "), F.col("c_name")).alias("title"), F.lit("20240603T102030Z").alias("seendate"), F.col("c_mktsegment").alias("domain"))
    rows = table(spark, sf_dir, "customer").select(F.floor(F.col("c_custkey") / 1000).alias("reply"), one.alias("a"))
    replies = rows.groupBy("reply").agg(F.collect_list("a").alias("articles")).select("reply", F.to_json(F.struct("articles")).alias("value"))  # 1,000 at the most in a reply, and a reply a file
    replies.write.partitionBy("reply").text(at)
    return feeds.article_lists(spark, at).withColumn("published_at", F.col("published_at").cast("timestamp_ntz"))


@query("SELECT p_partkey::VARCHAR AS url, p_brand AS source FROM part")
def paged_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a service that gives 100 rows a page; how many pages there are is found by doubling and halving, then each is a partition."""
    at = _folder(spark, "paged")
    rows = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 100).alias("page"), F.concat_ws("\t", "p_brand", F.col("p_partkey").cast("string")).alias("value"))
    rows.repartition(8, "page").write.partitionBy("page").text(at)

    def fetch(page: int) -> list[tuple]:
        folder = pathlib.Path(at.removeprefix("file:"), f"page={page}")
        return [tuple(x.split("\t")) for part in sorted(folder.glob("part-*")) for x in part.read_text().splitlines()]

    spark.dataSource.register(feeds.paged_source("pages_of_parts", fetch, "source string, url string"))
    full = feeds.last_page(lambda page: len(fetch(page)) >= 100)
    return spark.read.format("pages_of_parts").option("per_page", "100").option("pages", str(full + 1)).load().select("url", "source")


@query("""WITH c AS (SELECT o_custkey, min(o_orderdate)::DATE AS since, max(o_orderdate)::DATE AS until FROM orders GROUP BY 1)
 SELECT o_custkey, y::INTEGER AS year, greatest(since, make_date(y, 1, 1)) AS since, least(make_date(y, 12, 31), until - 365) AS until FROM c, LATERAL (SELECT unnest(range(year(since), year(until - 365) + 1)) AS y) WHERE since <= until - 365""")
def year_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calendar-year pieces of each customer's history, up to a delay before its end."""
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.to_date(F.min("o_orderdate")).alias("since"), F.to_date(F.max("o_orderdate")).alias("until"))
    return feeds.year_pieces(rows, "since", "until").select("o_custkey", "year", F.col("first").alias("since"), F.col("last").alias("until"))


@query("""SELECT o_orderkey::VARCHAR AS url, 'y' || year(o_orderdate) AS source FROM orders WHERE o_orderdate >= TIMESTAMP '1993-03-01' AND o_orderdate < TIMESTAMP '1997-08-01'""")
def paged_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as the history of a service that gives 50 rows a page: years, their pages found by doubling and halving, then all read at once.
    The service keeps a hundred pages in a file, in lines of one length, and reads the bytes of the page that it is asked for."""
    at, a_page, a_file, width = _folder(spark, "history"), 50, 100, 20
    year, day = F.year("o_orderdate").alias("year"), F.to_date("o_orderdate").alias("day")
    rows = table(spark, sf_dir, "orders").where((day >= "1993-03-01") & (day < "1997-08-01")).select(year, day, F.rpad(F.col("o_orderkey").cast("string"), width, " ").alias("value"), "o_orderdate", "o_orderkey")
    earlier = Window.partitionBy("year").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = rows.groupBy("year", "day").agg(F.count("*").alias("n")).select("year", "day", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("year", "day").orderBy("o_orderdate", "o_orderkey")) - 1
    rows = rows.join(F.broadcast(days), ["year", "day"]).select("year", place.alias("place"), "value")  # a row a day
    rows = rows.withColumn("file", F.floor(F.col("place") / (a_page * a_file))).repartition("year", "file").sortWithinPartitions("year", "file", "place")
    rows.select("year", "file", "value").write.partitionBy("year", "file").text(at)

    def fetch(since: str, until: str, page: int) -> list[tuple]:
        folder = pathlib.Path(at.removeprefix("file:"), f"year={since[:4]}", f"file={page // a_file}")
        for part in folder.glob("part-*"):  # one, if any
            with open(part, "rb") as f:
                f.seek(page % a_file * a_page * (width + 1))
                return [(f"y{until[:4]}", x) for x in f.read(a_page * (width + 1)).decode().split()]
        return []

    spark.dataSource.register(feeds.history_source("order_history", fetch, "source string, url string"))
    return spark.read.format("order_history").option("since", "1993-03-01").option("until", "1997-07-31").option("per_page", "50").load().select("url", "source")


@query("SELECT page_id, 'https://canonical/' || page_id AS canonical_url FROM pages WHERE page_id % 3 <> 0")
def resolved_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: addresses through a resolver on the workers; what it declines or fails at is dropped."""

    def resolver(x: str) -> str | None:
        n = int(x)
        if n % 6 == 0:
            raise OSError("down")
        return None if n % 3 == 0 else f"https://canonical/{n}"

    rows = table(spark, sf_dir, "pages").select("page_id", F.col("page_id").cast("string").alias("at"))
    return feeds.resolve(rows, "at", resolver).select("page_id", "canonical_url")


@query("""SELECT r_name, '(' || string_agg(CASE WHEN contains(t, ' ') THEN '"' || t || '"' ELSE t END, ' OR ' ORDER BY n_nationkey) || ') lang:x' AS q
 FROM (SELECT *, CASE WHEN n_nationkey % 2 = 0 THEN replace(n_name, '_', ' ') ELSE n_name END AS t FROM nation) JOIN region ON r_regionkey = n_regionkey GROUP BY 1""")
def boolean_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query of the names of each region's nations, phrases quoted."""
    from tidewatch.functions.text import search_query_of

    name = F.when(F.col("n_nationkey") % 2 == 0, F.replace("n_name", F.lit("_"), F.lit(" "))).otherwise(F.col("n_name"))
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    terms = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", name.alias("t")))), lambda x: x["t"])  # a list of keywords
    return rows.groupBy("r_name").agg(search_query_of(terms, "lang:x").alias("q"))


@query("""SELECT 'm' || strftime(o_orderdate, '%Y-%m') AS run_id, count(*) AS found, count(DISTINCT o_custkey) AS customers, max(o_orderdate) AS finished FROM orders GROUP BY 1""")
def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2: a run for each month of orders, appended to the log in two goes and read back."""
    at = _folder(spark, "runs")
    rows = table(spark, sf_dir, "orders").groupBy(F.concat(F.lit("m"), F.date_format("o_orderdate", "yyyy-MM")).alias("run_id")).agg(
        F.min("o_orderdate").alias("started_at"), F.max("o_orderdate").alias("finished_at"), F.map_from_arrays(F.array(F.lit("mode")), F.array(F.lit("full"))).alias("config"),
        F.map_from_arrays(F.array(F.lit("found"), F.lit("customers")), F.array(F.count("*"), F.count_distinct("o_custkey"))).alias("metrics"),
    )
    for part in ("run_id < 'm1995'", "run_id >= 'm1995'"):
        sinks.append_runs(rows.where(part), at)
    rows = spark.read.schema(schemas.RUN).parquet(at)
    return rows.select("run_id", F.col("metrics")["found"].alias("found"), F.col("metrics")["customers"].alias("customers"), F.col("finished_at").cast("timestamp_ntz").alias("finished"))


@query("SELECT o_orderkey AS event_id, o_orderpriority AS channel FROM orders WHERE o_orderstatus = 'F'")
def exported_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8: events exported as JSON lines and read back."""
    at = _folder(spark, "export-json")
    sinks.export_json(table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("event_id"), F.col("o_orderpriority").alias("channel")), at)
    return spark.read.schema("event_id long, channel string").json(at)


@query("SELECT lower(n_name) AS name, n_nationkey::INTEGER AS ord, n_nationkey / 4.0::DOUBLE AS lat, -n_nationkey / 2.0::DOUBLE AS lon FROM nation")
def gazetteer_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gazetteer of settings that workers write, in files by order; names in lower case, in the files' order."""
    at, key = _folder(spark, "places"), F.col("n_nationkey")
    line = F.concat(F.lit('"'), "n_name", F.lit('": {lat: '), (key / 4).cast("string"), F.lit(", lon: "), (-key / 2).cast("string"), F.lit("}"))
    table(spark, sf_dir, "nation").orderBy("n_nationkey").select(line.alias("value")).write.text(at)
    return config.gazetteer(spark, at, shared=True).select("name", "ord", "lat", "lon")


@query("""SELECT k.w AS keyword, k.g AS grp, (SELECT count(*) FROM documents WHERE contains(strip_accents(lower(coalesce(text, ''))), k.w)) AS hits FROM (SELECT DISTINCT split_part(p_name, ' ', 1) AS w, left(p_name, 1) AS g FROM part) k""")
def keyword_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword groups of settings that workers write, a file a group; how many documents have each keyword."""
    at, word = _folder(spark, "words"), F.split_part("p_name", F.lit(" "), F.lit(1))
    names = table(spark, sf_dir, "part").select(F.left("p_name", F.lit(1)).alias("g"), word.alias("w")).distinct()
    lines = names.groupBy("g").agg(F.array_join(F.transform(F.array_sort(F.collect_list("w")), lambda w: F.concat(F.lit("  - '"), w, F.lit("'  # word"))), "\n").alias("own"))
    lines.select(F.concat(F.lit("# words\n"), "g", F.lit(":\n"), "own").alias("value")).write.text(at)
    groups = [(k, g) for g, own in config.keyword_groups(at, spark).items() for k in own]
    hits = lookups.keyword_hits(table(spark, sf_dir, "documents"), "doc_id", "text", [k for k, _ in groups]).groupBy("keyword").agg(F.count("*").alias("hits"))
    rows = spark.createDataFrame(groups, "keyword string, grp string").join(hits, "keyword", "left")
    return rows.select("keyword", "grp", F.coalesce("hits", F.lit(0)).alias("hits"))
