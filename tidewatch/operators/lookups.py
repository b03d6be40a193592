"""Lookups by code, pair, label and text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import automaton
from tidewatch.functions.text import LITERALS, fold, fold_all

from . import dedup

#: Names of one automaton.
SHARD = 200_000


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def coded(code: Column, table: dict[str, str], default: str) -> Column:
    """The entry of a code, else of its first three, else of its first two characters, else the default."""
    known = _map(table)
    return F.coalesce(known[code], known[F.left(code, F.lit(3))], known[F.left(code, F.lit(2))], F.lit(default))


def paired(kind: Column, sub: Column, pairs: dict[tuple[str, str], str], single: dict[str, str], default: str) -> Column:
    """The entry of a pair, else of its first part alone, else the default; case and outer space don't count."""
    own = F.lower(F.trim(kind))
    both = _map({"\u0001".join(k): v for k, v in pairs.items()})
    return F.coalesce(both[F.concat(own, F.lit("\u0001"), F.lower(F.trim(sub)))], _map(single)[own], F.lit(default))


def translated(value: Column, table: dict[str, str]) -> Column:
    """A label in the other language, or as it is."""
    return F.coalesce(_map(table)[value], value)


def first_in_text(df: DataFrame, text: str, names: DataFrame, limit: int | None = None) -> DataFrame:
    """df with place, lat and lon of the first name, in the names' order, that is a substring of the lower-case text.

    names: ord, name, lat, lon; rows without a match get nulls. A few names are part of the plan; more are looked for by automata, and beyond
    SHARD different names by one part of about so many after the other, in their order, so that a worker holds one part at a time and a text that has a
    name of one part is not looked at for the next. A limit, where one is given, is checked.
    """
    rows = names.select("ord", "name", "lat", "lon").where("name is not null")
    few = rows.limit(LITERALS + 1).collect()
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    if len(few) <= LITERALS:
        hit = lambda entries: F.get(F.filter(entries, lambda e: F.contains(low, e["name"])), F.lit(0))
        none = F.lit(None).cast("struct<name:string,lat:double,lon:double>")
        found = df.withColumn("__hit", hit(F.array(*[F.struct(F.lit(r.name).alias("name"), F.lit(r.lat).alias("lat"), F.lit(r.lon).alias("lon")) for r in sorted(few)])) if few else none)
    else:
        if limit is not None and rows.count() > limit:
            raise ValueError(f"more than {limit} names")
        kind = rows.select(F.struct("ord", "name", "lat", "lon").alias("e")).schema["e"].dataType
        own = dedup.checkpointed(rows.groupBy("name").agg(F.min(F.struct("ord", "name", "lat", "lon")).alias("e")).select("e.*"))  # of equal names the first counts
        parts = -(-own.count() // SHARD)
        if parts > 1:
            own = dedup.checkpointed(own.repartitionByRange(parts, "ord", "name"))
        done, rest = [], df
        for k in range(parts):
            part = [tuple(r) for r in (own.where(F.spark_partition_id() == k) if parts > 1 else own).orderBy("ord", "name").collect()]  # about SHARD names
            side = df.sparkSession.createDataFrame([(part,)], f"__names array<{kind.simpleString()}>")
            found = rest.withColumn("__at", automaton.first_of(low, [r[1] for r in part])).join(F.broadcast(side))  # one row
            found = found.withColumn("__hit", F.get("__names", F.col("__at"))).drop("__at", "__names")
            if k < parts - 1:
                found = dedup.checkpointed(found)
                done.append(found.where("__hit is not null"))
                found = found.where("__hit is null")
                rest = found.drop("__hit")
                if rest.isEmpty():
                    break
        found = reduce(DataFrame.union, done, found)
    return found.select(*df.columns, F.initcap("__hit.name").alias("place"), F.col("__hit.lat").alias("lat"), F.col("__hit.lon").alias("lon"))


def keyword_hits(df: DataFrame, key: str, text: str, keywords: list[str]) -> DataFrame:
    """(key, keyword) of all folded keywords in a text."""
    if len(keywords) > LITERALS:
        own = F.array(*[F.lit(k) for k in keywords])
        return df.select(key, F.explode(automaton.all_of(fold(F.col(text)), fold_all(keywords))).alias("__i")).select(key, F.get(own, F.col("__i")).alias("keyword"))
    found = F.filter(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains(fold(F.col(text)), fold(k)))
    return df.select(key, F.explode(found).alias("keyword"))


def spread(members: DataFrame, results: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """members with a group's results over their own values, where the group has any."""
    new = results.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in columns])
    rows = members.join(new, F.col(key) == F.col("__k"), "left")
    return rows.select(*[F.coalesce(f"__{c}", c).alias(c) if c in columns else c for c in members.columns])
