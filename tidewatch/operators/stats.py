"""Counts, distributions and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def totals(events: DataFrame, articles: DataFrame) -> DataFrame:
    """One row: enriched events and articles that are no duplicates."""
    a = events.agg(F.count_if(F.col("status") == "enriched").alias("total_events"))
    return a.join(articles.agg(F.count_if(~F.col("is_duplicate")).alias("total_articles")))  # one row each


def by_label(df: DataFrame, column: str) -> DataFrame:
    """Rows by each label of an array, empty labels left out, most first."""
    rows = df.select(F.explode(column).alias("label")).where("label is not null and label <> ''")
    return rows.groupBy("label").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "label")


def by_value(df: DataFrame, column: str | Column, default: str | None = None) -> DataFrame:
    """Rows by value, most first; nulls are left out unless a default stands for them."""
    value = F.col(column) if isinstance(column, str) else column
    rows = df.select((value if default is None else F.coalesce(value, F.lit(default))).cast("string").alias("label"))
    return rows.where("label is not null").groupBy("label").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "label")


def by_day(df: DataFrame, column: str, days: int = 90) -> DataFrame:
    """Rows by day, the newest days that have any."""
    rows = df.where(F.col(column).isNotNull()).groupBy(F.date_format(column, "yyyy-MM-dd").alias("label"))
    return rows.agg(F.count("*").alias("count")).orderBy(F.desc("label")).limit(days)


def document(events: DataFrame, axes: dict[str, str]) -> DataFrame:
    """(axis, label, count) of several axes in one pass; axes: name to array or scalar column."""
    kinds = dict(events.dtypes)

    def tagged(axis: str, column: str) -> Column:
        values = F.col(column) if kinds[column].startswith("array") else F.array(F.col(column).cast("string"))
        return F.transform(values, lambda x: F.struct(F.lit(axis).alias("axis"), x.alias("label")))

    parts = [tagged(axis, column) for axis, column in axes.items()]
    rows = events.select(F.explode(F.concat(*[F.coalesce(p, F.array().cast("array<struct<axis:string,label:string>>")) for p in parts])).alias("x")).select("x.*")
    return rows.where("label is not null and label <> ''").groupBy("axis", "label").agg(F.count("*").alias("count"))


def share_of_max(counts: DataFrame, scale: float = 100.0, least: float = 3.0) -> DataFrame:
    """counts with bar: the share of the largest count, scaled, not below a floor. For distributions, which are small."""
    top = counts.agg(F.max("count").alias("__top"))
    return counts.join(F.broadcast(top)).withColumn("bar", F.greatest(F.lit(least), F.col("count") / F.col("__top") * scale)).drop("__top")


def per_day(df: DataFrame, column: str) -> DataFrame:
    """One row: rows, days with any, and rows a day."""
    rows = df.agg(F.count("*").alias("total"), F.count_distinct(F.to_date(column)).alias("days"))
    return rows.withColumn("average", F.col("total") / F.greatest("days", F.lit(1)))


def recent(df: DataFrame, column: str, as_of: Column, hours: int = 1, most: int = 200) -> DataFrame:
    """How many rows are newer than some hours, not counting beyond a cap."""
    return df.where(F.col(column) >= as_of - F.make_dt_interval(F.lit(0), F.lit(hours), F.lit(0), F.lit(0))).limit(most).agg(F.count("*").alias("recent"))


def roll_up(articles: DataFrame) -> DataFrame:
    """One row an event of article_id, event_id, ord, cluster_id, lat, lon, country, source, summary, title.

    Mean coordinates; the most frequent country and cluster, first met on ties; the first article with a summary,
    else the first, stands for the event; sources sorted; articles in order.
    """
    rows = articles.where("coalesce(event_id, '') <> ''")

    def most(column: str, name: str) -> DataFrame:
        counts = rows.where(F.col(column).isNotNull()).groupBy("event_id", column).agg(F.count("*").alias("n"), F.min("ord").alias("o"))
        return counts.groupBy("event_id").agg(F.min_by(column, F.struct((-F.col("n")).alias("n"), "o")).alias(name))

    stands = F.struct((F.coalesce("summary", F.lit("")) == "").alias("none"), "ord")
    groups = rows.groupBy("event_id").agg(
        F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.count("*").alias("article_count"), F.array_sort(F.collect_set("source")).alias("sources"),
        F.min_by("title", stands).alias("title"), F.min_by("summary", stands).alias("summary"),
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "article_id"))), lambda x: x["article_id"]).alias("articles"),
    )
    return groups.join(most("country", "country"), "event_id", "left").join(most("cluster_id", "cluster_id"), "event_id", "left")


def with_sub_events(events: DataFrame, extra: str) -> DataFrame:
    """events and, for each further location of an array of structs, a row of its own with the id `<id>-2`, `<id>-3`…"""
    more = events.select("*", F.posexplode(extra).alias("__i", "__l"))
    own = {"event_id": F.concat_ws("-", "event_id", (F.col("__i") + 2).cast("string")), "lat": F.col("__l.lat"), "lon": F.col("__l.lon")}
    return events.unionByName(more.select(*[own.get(c, F.col(c)).alias(c) for c in events.columns]))


def metrics(df: DataFrame, **conditions: Column) -> DataFrame:
    """One row of counts by condition."""
    return df.agg(*[F.count_if(c).alias(name) for name, c in conditions.items()])


def cluster_sizes(df: DataFrame, cluster: str, source: str, duplicate: Column) -> DataFrame:
    """One row: clusters, median and largest size, share of noise (cluster -1), duplicates."""
    sizes = df.where(F.col(cluster) != -1).groupBy(cluster).agg(F.count("*").alias("n"))
    a = sizes.agg(F.count("*").alias("clusters"), F.median("n").cast("double").alias("median_size"), F.max("n").alias("max_size"))
    b = df.agg(F.avg((F.col(cluster) == -1).cast("double")).alias("noise_share"), F.count_if(duplicate).alias("duplicates"), F.count_distinct(source).alias("sources"))
    return a.join(b)  # one row each


def cluster_sources(df: DataFrame, cluster: str, source: str) -> DataFrame:
    """(cluster, sources): distinct sources of each cluster, noise left out."""
    return df.where(F.col(cluster) != -1).groupBy(cluster).agg(F.count_distinct(source).alias("sources"))


def representative_titles(articles: DataFrame, group: str, order: str = "ord") -> DataFrame:
    """(group, title): the first title of a group's members that is not empty, in order."""
    title = F.nullif(F.trim("title"), F.lit(""))
    return articles.groupBy(group).agg(F.min_by(title, F.when(title.isNotNull(), F.col(order))).alias("title"))


def places(events: DataFrame) -> DataFrame:
    """One row: events, those with coordinates, and their share."""
    some = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    return events.agg(F.count("*").alias("events"), F.count_if(some).alias("geocoded"), F.avg(some.cast("double")).alias("share"))


def size_histogram(df: DataFrame, cluster: str) -> DataFrame:
    """Clusters by size in equal bins, ten or a fifth of the clusters; the largest size is in the last bin."""
    sizes = df.where(F.col(cluster) != -1).groupBy(cluster).agg(F.count("*").alias("n"))
    ends = sizes.agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.greatest(F.lit(10), F.floor(F.count("*") / 5)).cast("int").alias("bins"))
    rows = sizes.join(F.broadcast(ends))  # one row
    bin_of = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.col("bins") - 1, F.floor((F.col("n") - F.col("lo")) * F.col("bins") / (F.col("hi") - F.col("lo"))))).cast("int")
    return rows.groupBy(bin_of.alias("bin")).agg(F.count("*").alias("clusters"))


def members(df: DataFrame, cluster: str, key: str) -> DataFrame:
    return df.groupBy(cluster).agg(F.array_sort(F.collect_list(key)).alias("members"))
