"""The supplied tables as articles, events and locations; fixed present."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

def as_of() -> Column:
    """The present of all queries."""
    return F.lit(datetime(2024, 1, 31)).cast("timestamp_ntz")


AS_OF_SQL = "TIMESTAMP '2024-01-31 00:00:00'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def coordinates(key: str) -> dict:
    """Planar coordinates of a key, by integer arithmetic."""
    return {"lat": 34.8 + (F.col(key) * 37 % 720) / 100, "lon": 19.3 + (F.col(key) * 53 % 900) / 100}


LAT_SQL, LON_SQL = "34.8 + ({0} * 37 % 720) / 100.0::DOUBLE", "19.3 + ({0} * 53 % 900) / 100.0::DOUBLE"


def orders_as_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("event_id"), F.when(F.col("o_orderstatus") == "F", "enriched").otherwise("pending_review").alias("status"),
        F.col("o_orderpriority").alias("channel"), F.col("o_orderdate").alias("first_seen"),
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate") + F.expr("interval 3 days")).alias("last_seen"), F.col("o_custkey").alias("region"),
    )
    return rows.withColumns(coordinates("event_id"))


EVENTS_SQL = f"""events_ AS (SELECT o_orderkey AS event_id, CASE WHEN o_orderstatus = 'F' THEN 'enriched' ELSE 'pending_review' END AS status,
 o_orderpriority AS channel, o_orderdate AS first_seen, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate + INTERVAL 3 DAY END AS last_seen, o_custkey AS region,
 {LAT_SQL.format('o_orderkey')} AS lat, {LON_SQL.format('o_orderkey')} AS lon FROM orders)"""


def lines_as_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("event_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("article_id"), F.col("l_linestatus").alias("source"),
        F.when(F.col("l_partkey") % 11 != 0, F.col("l_shipdate")).alias("published_at"), (F.col("l_returnflag") == "R").alias("is_duplicate"),
    )


ARTICLES_SQL = """articles_ AS (SELECT l_orderkey AS event_id, concat_ws('-', l_orderkey, l_linenumber) AS article_id, l_linestatus AS source,
 CASE WHEN l_partkey % 11 <> 0 THEN l_shipdate END AS published_at, l_returnflag = 'R' AS is_duplicate FROM lineitem)"""


def parts_as_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("labels"), "p_brand", "p_type", "p_size")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as embedded articles: cluster from label, time from the event of the same number."""
    e, v = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "events")
    rows = e.join(v, e["vec_id"] == v["event_id"]).select(
        F.col("vec_id").alias("article_id"), "embedding", F.col("label").alias("cluster_id"), F.col("ts").alias("published_at"), "event_type", "user_id", "value"
    )
    return rows


VECTORS_SQL = """vectors_ AS (SELECT vec_id AS article_id, list_transform(embedding, lambda x: x::DOUBLE) AS embedding, label AS cluster_id, ts AS published_at,
 event_type, user_id, value FROM embeddings JOIN events ON event_id = vec_id)"""
