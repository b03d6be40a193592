"""Event lists, details and reports: filters, order with NULLs placed as the serving contract has them, pages."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.geo import in_box
from tidewatch.functions.moments import range_start
from tidewatch.sources.schemas import STATUSES


def conjunction(conditions: list[Column | None]) -> Column:
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def equal(column: str, value) -> Column | None:
    """Equality that a missing or empty argument switches off."""
    return F.col(column) == value if value else None


def parse_iso(text: str | None) -> datetime | None:
    return datetime.fromisoformat(text.replace("Z", "+00:00")) if text else None


def list_events(
    events: DataFrame, *, action_form: str | None = None, thematic_field: str | None = None, channel: str | None = None, intensity: str | None = None,
    region_code: str | None = None, date_from: str | None = None, date_to: str | None = None, bbox: str | None = None, limit: int = 50, offset: int = 0,
) -> DataFrame:
    """A page of enriched events, newest activity first, without activity last.

    Dates contain: first_seen from date_from on and last_seen up to date_to. A box without four parts is ignored.
    """
    if not (1 <= limit <= 1000 and offset >= 0):
        raise ValueError("limit is 1 to 1000 and offset 0 or more")
    def moment(text: str, column: str) -> Column:
        return F.lit(parse_iso(text)).cast(events.schema[column].dataType)  # in the column's own type, so that it reaches the scan

    wanted = conjunction([
        F.col("status") == "enriched",
        F.array_contains("action_forms", action_form) if action_form else None,
        F.array_contains("thematic_fields", thematic_field) if thematic_field else None,
        equal("channel", channel), equal("intensity", intensity), equal("region_code", region_code),
        F.col("first_seen") >= moment(date_from, "first_seen") if date_from else None,
        F.col("last_seen") <= moment(date_to, "last_seen") if date_to else None,
        in_box(F.col("lat"), F.col("lon"), bbox),
    ])
    return page(events.where(wanted), "last_seen", limit, offset)


def page(events: DataFrame, by: str, limit: int, offset: int = 0) -> DataFrame:
    rows = events.orderBy(F.desc_nulls_last(by), "event_id")
    return (rows.offset(offset) if offset else rows).limit(limit)


def admin_events(events: DataFrame, status: str | None = None, region_code: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """The moderation queue, newest first; an unknown status filters nothing."""
    known = status if status in STATUSES else None
    return page(events.where(conjunction([equal("status", known), equal("region_code", region_code)])), "first_seen", limit, offset)


def multi_select(events: DataFrame, arrays: dict[str, list[str]], scalars: dict[str, list[str]]) -> DataFrame:
    """Any of the values within an axis, all axes together; an axis without values is open."""
    conditions = [F.arrays_overlap(c, F.array(*map(F.lit, v))) for c, v in arrays.items() if v]
    conditions += [F.col(c).isin(v) for c, v in scalars.items() if v]
    return events.where(conjunction(conditions))


def search(events: DataFrame, term: str, *columns: str) -> DataFrame:
    """Case-blind substring of the first column that isn't null; a blank term keeps all."""
    low = term.strip().lower()
    return events.where(F.contains(F.lower(F.coalesce(*columns, F.lit(""))), F.lit(low))) if low else events


def since(events: DataFrame, column: str, name: str, as_of: Column) -> DataFrame:
    start = range_start(name, as_of)
    return events if start is None else events.where(F.col(column) >= start)


def top_articles(articles: DataFrame, n: int, key: str = "event_id") -> DataFrame:
    """The newest n articles of each event, undated ones first; ties by id."""
    at = Window.partitionBy(key).orderBy(F.desc_nulls_first("published_at"), "article_id")
    return articles.withColumn("rank", F.row_number().over(at)).where(F.col("rank") <= n)


def event_detail(events: DataFrame, articles: DataFrame, n: int = 20) -> DataFrame:
    """Each event with its newest n articles that are no duplicates, as a nested list in order."""
    top = top_articles(articles.where("not is_duplicate"), n)
    nested = top.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("rank", "article_id", "title", "published_at"))).alias("articles"))
    return events.join(nested, "event_id", "left")


def admin_detail(events: DataFrame, locations: DataFrame, articles: DataFrame) -> DataFrame:
    """Each event with its locations, primary first, and all its articles, duplicates too."""
    places = locations.groupBy("event_id").agg(
        F.array_sort(F.collect_list(F.struct((~F.col("is_primary")).alias("later"), "location_id", "location_name", "lat", "lon"))).alias("locations")
    )
    rows = articles.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("article_id", "title", "is_duplicate"))).alias("articles"))
    return events.join(places, "event_id", "left").join(rows, "event_id", "left")


def report(events: DataFrame, articles: DataFrame) -> DataFrame:
    """One line for each canonical article of an event; order: larger events, then id, then oldest article, undated last."""
    rows = events.join(articles.where("not is_duplicate"), "event_id")
    return rows.orderBy(F.desc("article_count"), "event_id", F.asc_nulls_last("published_at"), "article_id").withColumn("cluster_id", F.left("event_id", F.lit(8)))


def validate(edits: DataFrame, domains: dict[str, list[str]], arrays: dict[str, list[str]]) -> DataFrame:
    """edits with errors: a message for each column whose value, or any of whose values, is outside its domain."""
    bad = [F.when(~F.coalesce(F.col(c).isin(v), F.lit(False)), F.lit(f"Invalid {c}.")) for c, v in domains.items()]
    bad += [F.when(F.size(F.array_except(c, F.array(*map(F.lit, v)))) > 0, F.lit(f"Invalid {c}.")) for c, v in arrays.items()]
    return edits.withColumn("errors", F.array_compact(F.array(*bad)))


def by_category(events: DataFrame, category: str | None = None, country: str | None = None) -> DataFrame:
    """Events of a category, exactly, and of a country, without regard to case; either may be left out."""
    return events.where(conjunction([equal("category", category), F.lower("country") == country.lower() if country else None]))


def fullest(articles: DataFrame, key: str = "event_id") -> DataFrame:
    """(key, article_id): each group's article with the longest text among its canonical ones, else among all; smaller id on ties."""
    rank = F.struct(F.col("is_duplicate").alias("dup"), (-F.length(F.coalesce("body_text", F.lit("")))).alias("size"), "article_id")
    return articles.groupBy(key).agg(F.min_by("article_id", rank).alias("article_id"))
