"""Readers of article feeds: RSS, NDJSON, event exports, article lists and paged services."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from datetime import date, datetime, timedelta
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidewatch.functions import text as T
from tidewatch.operators.lookups import coded

from .schemas import RAW

RSS_ITEM = "title string, link string, guid string, pubDate string, source struct<_VALUE:string,_url:string>"
RSS_FLAT = "title string, link string, guid string, pubDate string, source string, _corrupt_record string"
#: At most so many articles of a keyword go on.
PER_KEYWORD = 15
#: Pages of a history's partition at most, and partitions up to which each is a page.
RUN, PARTS = 64, 256


def rss_items(spark: SparkSession, path: str) -> DataFrame:
    """(title, url, source, published_at) of all items under a path; unreadable feeds have none.

    The link is used, else the guid; items with neither are dropped. A title loses its source's name at the end.
    """
    rows = spark.read.format("xml").option("rowTag", "item").schema(RSS_ITEM).option("mode", "DROPMALFORMED").load(path)
    url = F.coalesce(F.nullif(F.trim("link"), F.lit("")), F.nullif(F.trim("guid"), F.lit("")))
    source = F.coalesce("source._VALUE", F.lit(""))
    rows = rows.select(F.trim(F.coalesce("title", F.lit(""))).alias("title"), url.alias("url"), source.alias("source"), T.mail_date(F.col("pubDate")).alias("published_at"))
    return rows.where("url is not null").withColumn("title", T.strip_source_suffix(F.col("title"), F.col("source")))


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in an order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def capped(df: DataFrame, group: str, order: list, most: int = PER_KEYWORD) -> DataFrame:
    """The first rows of each group in an order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("__n") <= most).drop("__n")


def resolve(df: DataFrame, column: str, resolver: Callable[[str], str | None]) -> DataFrame:
    """df with canonical_url from a resolver that workers call; rows that it fails or declines are dropped."""
    schema = df.withColumn("canonical_url", F.lit("")).schema
    at = df.columns.index(column)

    def one(x: str | None) -> str | None:
        try:
            return resolver(x) if x else None
        except Exception:  # a page that can't be resolved is a row less, never a failed job
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([one(x) for x in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, "canonical_url"]).filter(found.is_valid())

    return df.mapInArrow(run, schema)


def resolve_by(df: DataFrame, column: str, lookup: DataFrame) -> DataFrame:
    """df with canonical_url from a table (url, canonical_url); unknown addresses are dropped."""
    return df.join(lookup.select(F.col("url").alias("__u"), "canonical_url"), F.col(column) == F.col("__u")).drop("__u")


def _line() -> Column:
    """Orders the lines of a file: by the split that they are read in, then within it; splits of a file need not be read in order."""
    return F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line"))


def raw_records(spark: SparkSession, path: str) -> DataFrame:
    """NDJSON records under a folder, by file and line: malformed and blank lines, records without title and body, and
    later records of one address are left out."""
    rows = spark.read.schema(RAW + ", _corrupt_record string").option("recursiveFileLookup", "true").option("mode", "PERMISSIVE").json(path)
    rows = rows.withColumn("__file", F.col("_metadata.file_path")).withColumn("__at", _line()).where("_corrupt_record is null")
    full = (F.coalesce(F.trim("title"), F.lit("")) != "") | (F.coalesce(F.trim("body"), F.lit("")) != "")
    rows = rows.where(full & (F.coalesce("url", F.lit("")) != ""))
    return first_by(rows, ["url"], ["__file", "__at"]).drop("__file", "__at", "_corrupt_record").withColumn("id", T.url_id(F.col("url")))


#: Places of the columns used in the 61 tab-separated columns of an event export.
EXPORT = {"event_id": 0, "day": 1, "event_code": 26, "root_code": 28, "goldstein": 30, "mentions": 31, "tone": 34, "place": 52, "country": 53, "lat": 56, "lon": 57, "url": 60}
EXPORT_COLUMNS = 61
#: Country, and root codes of protest, coercion, assault and fight.
COUNTRY, ROOT_CODES = "GR", ("14", "17", "18", "19")
#: Category of an event code; longer codes fall back to their first three, then two characters.
EVENT_CATEGORY = {
    "14": "mass_mobilization", "141": "mass_mobilization", "1411": "mass_mobilization", "1412": "mass_mobilization", "1413": "labor_economic",
    "1414": "labor_economic", "1415": "mass_mobilization", "1416": "conflict", "17": "mass_mobilization", "171": "mass_mobilization",
    "172": "mass_mobilization", "18": "conflict", "181": "conflict", "182": "conflict", "183": "conflict", "184": "conflict", "185": "conflict",
    "186": "conflict", "19": "conflict", "190": "conflict", "191": "conflict", "192": "conflict", "193": "conflict", "194": "conflict",
    "195": "conflict", "196": "conflict",
}


def event_exports(spark: SparkSession, path: str, country: str = COUNTRY, roots: tuple[str, ...] = ROOT_CODES) -> DataFrame:
    """Records of tab-separated exports: short lines dropped, one country and the root codes kept, first of each event id."""
    lines = spark.read.text(path).withColumn("__file", F.col("_metadata.file_path")).withColumn("__at", _line())
    return export_records(lines.withColumn("c", F.split("value", "\t", -1)).where(F.size("c") >= EXPORT_COLUMNS), country, roots)


def zipped_exports(spark: SparkSession, path: str, country: str = COUNTRY, roots: tuple[str, ...] = ROOT_CODES) -> DataFrame:
    """The same for zipped exports; workers unpack, a file a row."""

    def unpack(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    for inner in z.namelist():
                        with z.open(inner) as f:
                            lines = [x.decode("utf-8", "replace").rstrip("\r\n") for x in f]
                        yield pa.RecordBatch.from_pydict({"value": pa.array(lines, pa.string()), "__file": [name] * len(lines), "__at": pa.array(range(len(lines)), pa.int64())})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    lines = files.mapInArrow(unpack, "value string, __file string, __at long")
    return export_records(lines.withColumn("c", F.split("value", "\t", -1)).where(F.size("c") >= EXPORT_COLUMNS), country, roots)


def export_records(rows: DataFrame, country: str, roots: tuple[str, ...]) -> DataFrame:
    c = {k: F.trim(F.col("c")[i]) for k, i in EXPORT.items()}
    rows = rows.where((c["country"] == country) & c["root_code"].isin(*roots)).withColumn("event_id", F.col("c")[0])
    rows = first_by(rows, ["event_id"], ["__file", "__at"])
    return rows.select(
        "event_id", c["url"].alias("url"), F.lit("").alias("title"), F.lit("").alias("body"), T.day(c["day"]).alias("published_on"),
        coded(c["event_code"], EVENT_CATEGORY, "conflict").alias("category_hint"), T.safe_double(c["lat"]).alias("lat"), T.safe_double(c["lon"]).alias("lon"),
        c["place"].alias("location_name"), c["event_code"].alias("event_code"), T.safe_double(c["goldstein"]).alias("goldstein_scale"),
        T.safe_double(c["tone"]).alias("avg_tone"), T.safe_int(c["mentions"]).alias("num_mentions"),
    )


def export_files(latest: datetime, hours: int, base: str) -> list[str]:
    """The addresses of the quarter-hourly exports of the hours before the latest one, newest first."""
    return [f"{base}{latest - timedelta(minutes=15 * k):%Y%m%d%H%M%S}.export.CSV.zip" for k in range(max(1, 4 * hours))]


def article_lists(spark: SparkSession, path: str) -> DataFrame:
    """Articles of JSON replies {"articles": [...]}: first of each url, the rest without a url dropped."""
    schema = "articles array<struct<url:string,title:string,seendate:string,domain:string,language:string>>"
    rows = spark.read.schema(schema).option("multiLine", "true").json(path).withColumn("__file", F.col("_metadata.file_path"))
    rows = rows.select("__file", F.posexplode("articles").alias("__at", "a")).select("__file", "__at", "a.*").where("coalesce(trim(url), '') <> ''")
    rows = first_by(rows, ["url"], ["__file", "__at"]).drop("__file", "__at")
    return rows.select("url", T.clean_space(F.coalesce("title", F.lit(""))).alias("title"), "domain", T.compact_stamp(F.col("seendate")).alias("published_at"))


#: Category of a conflict record's type and sub-type, and of its type alone; all else is conflict.
PAIR_CATEGORIES = {
    ("protests", "peaceful protest"): "mass_mobilization",
    ("protests", "labor dispute/strike"): "labor_economic",
    ("protests", "violent demonstration"): "conflict",
    ("protests", "protest with intervention"): "conflict",
    ("protests", "mob violence"): "conflict",
    ("riots", "violent demonstration"): "conflict",
    ("riots", "mob violence"): "conflict",
    ("strategic developments", "looting/property destruction"): "conflict",
    ("strategic developments", "agreement"): "institutional_political",
    ("strategic developments", "arrests"): "institutional_political",
    ("strategic developments", "change to group/activity"): "institutional_political",
    ("strategic developments", "disrupted weapons use"): "institutional_political",
    ("strategic developments", "headquarters or base established"): "institutional_political",
    ("strategic developments", "non-violent transfer of territory"): "institutional_political",
    ("strategic developments", "other"): "institutional_political",
    ("strategic developments", "takeover"): "institutional_political",
}
TYPE_CATEGORY = {
    "protests": "mass_mobilization", "riots": "conflict", "battles": "conflict", "explosions/remote violence": "conflict",
    "violence against civilians": "conflict", "strategic developments": "institutional_political",
}


def years(since: date, until: date, delay_days: int = 365) -> list[tuple[date, date]]:
    """Calendar-year pieces of a historical range, which ends a delay before the last day at the latest."""
    end = until - timedelta(days=delay_days)
    return [(max(since, date(y, 1, 1)), min(end, date(y, 12, 31))) for y in range(since.year, end.year + 1) if since <= end]


def year_pieces(df: DataFrame, since: str, until: str, delay_days: int = 365) -> DataFrame:
    """df with year, first and last: a row for each calendar-year piece of a row's own range (days), which ends a delay before its end; a range
    that is shorter than the delay, or has no bounds, has none."""
    end = F.date_sub(F.col(until), delay_days)
    year = F.explode(F.when(F.col(since) <= end, F.sequence(F.year(since), F.year(end))))
    rows = df.withColumn("year", year)
    day = lambda month, of: F.make_date("year", F.lit(month), F.lit(of))
    return rows.withColumns({"first": F.greatest(F.col(since), day(1, 1)), "last": F.least(end, day(12, 31))})


def paged_source(name: str, fetch: Callable[[int], list[tuple]], schema: str = RAW) -> type[DataSource]:
    """A paged service as a source to register. fetch takes a page number and returns its rows.

    With the option pages, each page is a partition. Without it, how many there are is not known: one partition asks for page
    after page, until one has fewer rows than the option per_page says, or none.
    """

    class Page(InputPartition):
        pass

    class Reader(DataSourceReader):
        def __init__(self, pages: int | None, per_page: int):
            self.pages, self.per_page = pages, per_page

        def partitions(self) -> list[InputPartition]:
            return [Page(None)] if self.pages is None else [Page(i) for i in range(self.pages)]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            if partition.value is not None:
                yield from fetch(partition.value)
                return
            page, rows = 0, None
            while rows is None or len(rows) >= self.per_page:
                rows = fetch(page)
                yield from rows
                page += 1

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema) -> DataSourceReader:
            pages = self.options.get("pages")
            return Reader(None if pages is None else int(pages), int(self.options.get("per_page", "1")))

    return Paged


def last_page(full: Callable[[int], bool]) -> int:
    """The number of full pages of a list, by doubling and then halving: full says whether a page, counted from 0, has all its rows."""
    low, step = 0, 1  # pages below low are full
    while full(low + step - 1):
        low, step = low + step, step * 2
    high = low + step - 1  # this page is not full
    while low < high:
        middle = (low + high) // 2
        if full(middle):
            low = middle + 1
        else:
            high = middle
    return low


def history_source(name: str, fetch: Callable[[str, str, int], list[tuple]], schema: str = RAW) -> type[DataSource]:
    """A paged service with a history as a source to register. fetch takes the first and last day of a piece and a page of it, and returns its rows.

    The options since and until (days) are split into calendar years. How many pages a year has is found on the driver with calls in the
    order of twice the logarithm of their number, whose rows are not kept; then every page is a partition, or, where there are more than PARTS, every few
    consecutive ones, RUN at most. Option per_page: rows of a full page.
    """

    class Page(InputPartition):
        pass

    class Reader(DataSourceReader):
        def __init__(self, since: date, until: date, per_page: int):
            self.pieces, self.per_page = years(since, until, 0), per_page

        def partitions(self) -> list[InputPartition]:
            found = []
            for a, b in self.pieces:
                first, last = a.isoformat(), b.isoformat()
                full = last_page(lambda page, first=first, last=last: len(fetch(first, last, page)) >= self.per_page)
                found.append((first, last, full + 1))  # the last page is short, or empty
            run = max(1, min(RUN, sum(n for *_, n in found) // PARTS))
            return [Page((first, last, page, min(page + run, n))) for first, last, n in found for page in range(0, n, run)] or [Page(None)]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            if partition.value is not None:
                first, last, start, stop = partition.value
                for page in range(start, stop):
                    yield from fetch(first, last, page)

    class History(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema) -> DataSourceReader:
            return Reader(date.fromisoformat(self.options["since"]), date.fromisoformat(self.options["until"]), int(self.options.get("per_page", "1")))

    return History


def union_all(frames: list[DataFrame]) -> DataFrame:
    """All rows of several sources; columns that one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
