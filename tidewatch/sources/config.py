"""Keyword lists, gazetteers and service settings, read on the driver."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Characters of a file of shapes, at most.
MOST_CHARS = 32 << 20


def _lines(path: str, spark: SparkSession | None = None, most: int = MOST_CHARS):
    """The lines of a settings file without comments: of the driver's, or, with a session, of a file or folder that workers share, by name, of so many characters."""
    if spark is None:
        with open(path, encoding="utf-8") as f:
            texts = [f.read()]
    else:
        files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("at"), "value")
        if (files.agg(F.sum(F.length("value"))).first()[0] or 0) > most:
            raise ValueError(f"{path} has over {most} characters")
        texts = [r.value for r in sorted(files.collect())]
    for line in (line for text in texts for line in text.split("\n")):
        bare = re.sub(r"(^|\s)#.*$", "", line.rstrip("\r"))
        if bare.strip():
            yield bare


def keyword_groups(path: str, spark: SparkSession | None = None) -> dict[str, list[str]]:
    """Groups of a file of `group:` lines followed by `- keyword` lines."""
    groups: dict[str, list[str]] = {}
    for line in _lines(path, spark):
        if line.lstrip().startswith("- "):
            groups[next(reversed(groups))].append(line.strip()[2:].strip().strip("\"'"))
        else:
            groups[line.strip().rstrip(":")] = []
    return groups


def keywords(path: str) -> list[str]:
    return [k for group in keyword_groups(path).values() for k in group]


def gazetteer(spark: SparkSession, path: str, shared: bool = False) -> DataFrame:
    """(ord, name, lat, lon) of a file of `"Name": {lat: x, lon: y}` lines; names in lower case, in file order. shared: whether workers see the path."""
    rows = []
    for line in _lines(path, spark if shared else None):
        m = re.match(r"""["']?(.+?)["']?\s*:\s*\{\s*lat:\s*([-\d.]+)\s*,\s*lon:\s*([-\d.]+)\s*\}""", line.strip())
        if m:
            rows.append((len(rows), m[1].lower(), float(m[2]), float(m[3])))
    return spark.createDataFrame(rows, "ord int, name string, lat double, lon double")


def polygon(spark: SparkSession, path: str) -> DataFrame:
    """One row: the rings of all polygons of a GeoJSON file, as array<array<struct<x,y>>>, for features that are disjoint; see features."""
    rings = [[(float(x), float(y)) for x, y, *_ in ring] for feature in features(spark, path) for part in feature for ring in part]
    return spark.createDataFrame([(rings,)], "rings array<array<struct<x:double,y:double>>>")


def features(spark: SparkSession, path: str, most: int = MOST_CHARS) -> list[list[list[list[tuple]]]]:
    """The polygons of each feature of a GeoJSON file, or of a table of files with a feature a line, each a ring and its holes.

    Shapes go into plans, so their size is checked: one file of a feature collection, or lines, of so many characters in all.
    """
    lines = spark.read.text(path, wholetext=True)
    if (lines.agg(F.sum(F.length("value"))).first()[0] or 0) > most:
        raise ValueError(f"{path} has over {most} characters")
    found = []
    for r in lines.collect():
        try:
            found += json.loads(r.value)["features"]
        except (json.JSONDecodeError, KeyError):  # a feature a line
            found += [json.loads(x) for x in r.value.splitlines() if x.strip()]
    shapes = [f["geometry"] for f in found]
    return [[s["coordinates"]] if s["type"] == "Polygon" else s["coordinates"] for s in shapes]


def model_choice(explicit: str | None, keys: list[tuple[str | None, str]], local: str) -> str:
    """The model to use: the explicit one, else the first whose key is set, else the local one."""
    return explicit or next((model for key, model in keys if key), local)


def existing(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The given ids that df has."""
    return ids.join(df.select(key), key, "left_semi")


def health(spark: SparkSession, **tables: DataFrame) -> DataFrame:
    """(name, status) of the engine and of each table: ok, empty, or down where it can't be read."""
    found = {"engine": "ok"}
    for name, df in tables.items():
        try:
            found[name] = "empty" if df.isEmpty() else "ok"
        except Exception:  # whatever it is, the table gives no rows
            found[name] = "down"
    return spark.createDataFrame(list(found.items()), "name string, status string")
