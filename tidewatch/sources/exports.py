"""Quarter-hourly exports as a stream: an offset is a quarter hour, a file is a partition, and a restart goes on behind the last committed one."""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from . import feeds

STAMP = "%Y%m%d%H%M%S"
QUARTER = timedelta(minutes=15)
LINES = "value string, file string, line long"


def quarter(at: datetime) -> datetime:
    """The quarter hour that a time is in."""
    return at.replace(minute=at.minute // 15 * 15, second=0, microsecond=0)


def quarters(after: str, last: str) -> list[str]:
    """The stamps of the quarter hours after one and up to another."""
    at, end, out = datetime.strptime(after, STAMP) + QUARTER, datetime.strptime(last, STAMP), []
    while at <= end:
        out.append(at.strftime(STAMP))
        at += QUARTER
    return out


def lines_of(content: bytes) -> Iterator[str]:
    """The lines of an export, packed or not."""
    if content[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for name in z.namelist():
                with z.open(name) as f:
                    yield from (x.decode("utf-8", "replace").rstrip("\r\n") for x in f)
    else:
        yield from content.decode("utf-8", "replace").splitlines()


def export_source(name: str, fetch: Callable[[str], bytes | None]) -> type[DataSource]:
    """A streaming source to register. fetch takes a quarter hour's stamp, on the workers, and returns its file or None where there is none.

    Options: since, the stamp before the first quarter hour; until, the last one (the present's if none is said); both are stamps in UTC.
    Each batch has a partition for every quarter hour since the last one, so that what has been missed is read by many tasks.
    """

    class Quarter(InputPartition):
        pass

    class Reader(DataSourceStreamReader):
        def __init__(self, options: dict):
            self.since, self.until = options["since"], options.get("until")

        def initialOffset(self) -> dict:
            return {"at": self.since}

        def latestOffset(self) -> dict:
            return {"at": self.until or quarter(datetime.now(timezone.utc)).strftime(STAMP)}

        def partitions(self, start: dict, end: dict) -> list[InputPartition]:
            return [Quarter(stamp) for stamp in quarters(start["at"], end["at"])]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            content = fetch(partition.value)
            if content is not None:
                for i, line in enumerate(lines_of(content)):
                    yield line, partition.value, i

        def commit(self, end: dict) -> None:
            pass

    class Exports(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return LINES

        def streamReader(self, schema) -> DataSourceStreamReader:
            return Reader(dict(self.options))

    return Exports


def in_folder(path: str) -> Callable[[str], bytes | None]:
    """A fetch from a folder that all workers see, of files named by stamp as feeds.export_files has them, packed or not."""

    def fetch(stamp: str) -> bytes | None:
        for name in (f"{stamp}.export.CSV.zip", f"{stamp}.export.CSV"):
            if os.path.exists(f"{path}/{name}"):
                with open(f"{path}/{name}", "rb") as f:
                    return f.read()
        return None

    return fetch


def stream(spark: SparkSession, name: str, since: str, until: str | None = None) -> DataFrame:
    """The lines of a registered source."""
    reader = spark.readStream.format(name).option("since", since)
    return (reader.option("until", until) if until else reader).load()


def records(lines: DataFrame, country: str = feeds.COUNTRY, roots: tuple[str, ...] = feeds.ROOT_CODES) -> DataFrame:
    """The records of lines that a stream has stored, first of each event by quarter hour and line."""
    rows = lines.select(F.split("value", "\t", -1).alias("c"), F.col("file").alias("__file"), F.col("line").alias("__at"))
    return feeds.export_records(rows.where(F.size("c") >= feeds.EXPORT_COLUMNS), country, roots)
