"""Changes of the event tables as new snapshots: moderation, edits, deletion, links and the archival sweep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ARCHIVE_HOURS, CLOSE_DAYS = 72, 10


def moderate(events: DataFrame, decisions: DataFrame) -> DataFrame:
    """events after decisions (event_id, decision: approve or reject), which act on pending_review only."""
    rows = events.join(decisions.select("event_id", F.col("decision").alias("__d")), "event_id", "left")
    to = F.when(F.col("__d") == "approve", "enriched").when(F.col("__d") == "reject", "rejected")
    pending = (F.col("status") == "pending_review") & to.isNotNull()
    return rows.withColumn("status", F.when(pending, to).otherwise(F.col("status"))).select(*events.columns)


def edit(events: DataFrame, edits: DataFrame) -> DataFrame:
    """events with the rows that edits has in whole in place of theirs; edits of unknown events do nothing."""
    names = [c for c in edits.columns if c != "event_id"]
    rows = events.join(edits.select("event_id", F.struct(*names).alias("__e")), "event_id", "left")
    return rows.select(*[F.when(F.col("__e").isNotNull(), F.col(f"__e.{c}")).otherwise(F.col(c)).alias(c) if c in names else c for c in events.columns])


def edit_children(children: DataFrame, deletes: DataFrame, updates: DataFrame, inserts: DataFrame, key: str) -> DataFrame:
    """children without the deleted, with updated rows replaced and new ones added."""
    rows = children.join(deletes.select(key), key, "left_anti").join(updates.select(key), key, "left_anti")
    own = updates.join(children.select(key), key, "left_semi").join(deletes.select(key), key, "left_anti")
    return rows.unionByName(own).unionByName(inserts)


def delete_events(events: DataFrame, locations: DataFrame, articles: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All three tables without some events: locations go too, articles lose the link."""
    ids = gone.select("event_id").distinct()
    freed = articles.join(ids.select(F.col("event_id").alias("__g")), F.col("event_id") == F.col("__g"), "left")
    freed = freed.withColumn("event_id", F.when(F.col("__g").isNull(), F.col("event_id"))).select(*articles.columns)
    return events.join(ids, "event_id", "left_anti"), locations.join(ids, "event_id", "left_anti"), freed


def idle_status(status: Column, last_seen: Column, as_of: Column) -> Column:
    """The status after a sweep: enriched and idle is archived, then archived and idle longer is closed, both in one sweep."""
    hours = F.make_dt_interval(F.lit(0), F.lit(ARCHIVE_HOURS), F.lit(0), F.lit(0))
    days = F.make_dt_interval(F.lit(CLOSE_DAYS), F.lit(0), F.lit(0), F.lit(0))
    archived = F.when((status == "enriched") & (last_seen < as_of - hours), "archived").otherwise(status)
    return F.when((archived == "archived") & (last_seen < as_of - days), "closed").otherwise(archived)


def sweep(events: DataFrame, articles: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Both tables after archive, prune and close, in this order: bodies of events that were archived at the prune are dropped."""
    hours = F.make_dt_interval(F.lit(0), F.lit(ARCHIVE_HOURS), F.lit(0), F.lit(0))
    at_prune = F.when((F.col("status") == "enriched") & (F.col("last_seen") < as_of - hours), "archived").otherwise(F.col("status"))
    pruned = events.where(at_prune == "archived").select(F.col("event_id").alias("__p")).distinct()
    rows = articles.join(pruned, F.col("event_id") == F.col("__p"), "left")
    rows = rows.withColumn("body_text", F.when(F.col("__p").isNull(), F.col("body_text"))).select(*articles.columns)
    return events.withColumn("status", idle_status(F.col("status"), F.col("last_seen"), as_of)), rows


def sweep_changes(events: DataFrame, articles: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """What sweep changes: (event_id, status, archived, closed) of the events that it moves, with the steps that moved them, and (article_id)
    of the bodies that it drops. An event that is archived and closed in one sweep counts for both."""
    hours = F.make_dt_interval(F.lit(0), F.lit(ARCHIVE_HOURS), F.lit(0), F.lit(0))
    due = F.coalesce((F.col("status") == "enriched") & (F.col("last_seen") < as_of - hours), F.lit(False))
    after = idle_status(F.col("status"), F.col("last_seen"), as_of)
    moved = events.select("event_id", after.alias("status"), due.alias("archived"), F.coalesce((after == "closed") & (F.col("status") != "closed"), F.lit(False)).alias("closed"))
    idle = events.where(due | (F.col("status") == "archived")).select("event_id").distinct()
    return moved.where("archived or closed"), articles.where("body_text is not null").join(idle, "event_id", "left_semi").select("article_id")


def link(articles: DataFrame, members: DataFrame, duplicates: DataFrame) -> DataFrame:
    """articles with event_id of members (article_id, event_id) and is_duplicate of duplicates (article_id)."""
    rows = articles.join(members.select("article_id", F.col("event_id").alias("__e")), "article_id", "left")
    rows = rows.join(duplicates.select("article_id").distinct().withColumn("__d", F.lit(True)), "article_id", "left")
    return rows.withColumn("event_id", F.coalesce("__e", "event_id")).withColumn("is_duplicate", F.coalesce("__d", "is_duplicate")).select(*articles.columns)


def add_counts(events: DataFrame, deltas: DataFrame) -> DataFrame:
    rows = events.join(deltas.groupBy("event_id").agg(F.sum("n").alias("__n")), "event_id", "left")
    return rows.withColumn("article_count", F.col("article_count") + F.coalesce("__n", F.lit(0))).select(*events.columns)


def needs(events: DataFrame) -> DataFrame:
    """Events to be enriched, with the three flags of what is missing: all that are detected, and of those that wait for review or
    are enriched the ones that lack something."""
    flags = {"needs_classify": F.col("channel").isNull(), "needs_geocode": F.col("lat").isNull(), "needs_summary": F.col("summary_el").isNull()}
    partial = F.col("status").isin("pending_review", "enriched") & (F.col("needs_classify") | F.col("needs_geocode") | F.col("needs_summary"))
    return events.withColumns(flags).where((F.col("status") == "detected") | partial)


def fill(events: DataFrame, results: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """events with only those column groups of results that their flags ask for; what was changed waits for review.

    groups: flag to columns. A result with an error is left out, so one bad event costs nothing else.
    """
    good = results.where("error is null") if "error" in results.columns else results
    names = [c for cs in groups.values() for c in cs]
    rows = needs(events).select("event_id", *groups).join(good.select("event_id", *[F.col(c).alias(f"__{c}") for c in names]), "event_id")
    rows = events.join(rows, "event_id", "left")
    flag = {c: g for g, cs in groups.items() for c in cs}
    new = {c: F.when(F.col(flag[c]), F.col(f"__{c}")).otherwise(F.col(c)) for c in names}
    touched = F.coalesce(*groups)
    new["status"] = F.when(touched.isNotNull(), "pending_review").otherwise(F.col("status"))
    return rows.select(*[new[c].alias(c) if c in new else c for c in events.columns])
