"""Operator 9: WARC archives as a chunked record table.

An archive is a table of chunks: archive, record, chunk number, chunks of the record, and bytes; the bytes
of an archive's chunks in order are a WARC/1.1 file. Records of one chunk are read where they lie; only the
chunks of oversized ones are brought together, in order. A payload goes out in pieces of bounded size and no step joins a record's
pieces in memory: the writer carries a digest from piece to piece and checks it against the column's, by which equal payloads were
found, and the reader carries another. Equal payloads
are stored once: the record of the smallest page_id is a response, the others are revisits that name it.

Defined cases: null html is an empty payload; empty payloads are deduplicated like others unless the least
size says otherwise; a null page_id orders last and its record has an id of its own; rows that repeat the
smallest page_id and its payload are responses all; other columns are ignored; an empty table gives empty
archives and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow_schema, as_batch, cut, scratch_table

#: Payload bytes in one chunk, and payloads below which nothing is deduplicated.
CHUNK, LEAST = 1 << 18, 0
#: Repeated digests that are sent to all workers, at most; about 100 bytes each.
BROADCAST = 500_000
#: Bytes in which a record's headers are looked for first.
_HEAD = 4096
DATE = "2024-01-31T00:00:00Z"
CHUNKS = "archive int, record long, chunk long, chunks long, data binary"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, record_id string"
_END = b"\r\n\r\n"
#: Header names and what HTTP stands before a payload in a response record.
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def records(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, url, html, digest, bytes, first) of every page; first is the page_id of its response, null for a response.

    Payloads stay where they are if the digests that occur twice are few enough to be sent to all workers. Beyond that, revisits, which
    need no payload, are found by keys and sizes alone, and payloads meet only the keys of the rows that keep them.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1("html")).withColumn("bytes", F.octet_length("html"))
    first = rows.where(F.col("bytes") >= least).groupBy("digest", "bytes").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    first = cut(first.drop("n"))
    revisits = ~F.col("page_id").eqNullSafe(F.col("first"))
    names = ["page_id", "url", "html", "digest", "bytes", "first"]
    if first.count() <= BROADCAST:
        both = rows.join(F.broadcast(first), ["digest", "bytes"], "left")
        return both.withColumn("first", F.when(F.col("first").isNotNull() & revisits, F.col("first"))).select(*names)
    again = rows.drop("html").join(first, ["digest", "bytes"]).where(F.col("first").isNotNull() & revisits).withColumn("html", F.lit(""))
    gone = again.select("page_id", "digest", "bytes").distinct()
    same = (F.col("page_id").eqNullSafe(F.col("__p"))) & (F.col("digest") == F.col("__d")) & (F.col("bytes") == F.col("__b"))
    gone = gone.select(F.col("page_id").alias("__p"), F.col("digest").alias("__d"), F.col("bytes").alias("__b"))
    kept = rows.join(gone, same, "left_anti").withColumn("first", F.lit(None).cast("long"))
    return kept.select(*names).unionByName(again.select(*names))


def _record_id(page_id: int | None, url: str) -> str:
    of = hashlib.sha1(f"{page_id}\n{url}".encode()).hexdigest() if page_id is None else f"{page_id:040x}"
    return f"urn:page:{of}"


def _base32(digest: str) -> str:
    return base64.b32encode(bytes.fromhex(digest)).decode()


def _header(kind: str, record_id: str, url: str, digest: str, length: int, more: list[str]) -> bytes:
    clean = re.sub(r"[\r\n]+", " ", url)
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {clean}",
        f"WARC-Payload-Digest: sha1:{_base32(digest)}", *more, "Content-Type: application/http;msgtype=response", f"Content-Length: {length}",
    ]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def chunked(rows: DataFrame, size: int = CHUNK) -> DataFrame:
    """The chunk rows of records(): a record of at most `size` payload bytes is one row, a larger one several."""
    arrow = arrow_schema(CHUNKS)

    def pieces(page, url: str, html: pa.Scalar, digest: str, n: int, first):
        """(chunk, chunks, bytes): headers with the payload's first piece, further pieces, the end in the last."""
        record = _record_id(page, url)
        more = [f"X-Page-ID: {'' if page is None else page}", f"X-Payload-Bytes: {n}"]
        if first is not None:
            http = b"HTTP/1.1 200 OK\r\n\r\n"
            more += [
                "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                f"WARC-Refers-To: <{_record_id(first, '')}>", f"X-Refers-To-Page: {first}",
            ]
            yield 0, 1, _header("revisit", record, url, digest, len(http), more) + http + _END
            return
        http = _HTTP % n
        head = _header("response", record, url, digest, len(http) + n, more) + http
        chunks = max(1, -(-n // size))
        payload, running = memoryview(html.as_buffer()), hashlib.sha1()
        for k in range(chunks):
            piece = bytes(payload[k * size : (k + 1) * size])
            running.update(piece)
            if k == chunks - 1 and running.hexdigest() != digest:
                raise ValueError(f"payload of {record} has another digest than its column")
            yield k, chunks, (head if k == 0 else b"") + piece + (_END if k == chunks - 1 else b"")

    def write(batches):
        archive, record = TaskContext.get().partitionId(), 0
        for batch in batches:
            held, total = [], 0
            for page, url, html, digest, n, first in zip(*(batch.column(i) for i in range(6)), strict=True):
                for k, chunks, data in pieces(page.as_py(), url.as_py(), html, digest.as_py(), n.as_py(), first.as_py()):
                    held.append((archive, record, k, chunks, data))
                    total += len(data)
                    if total >= 16 * CHUNK:
                        yield as_batch(list(zip(*held, strict=True)), arrow)
                        held, total = [], 0
                record += 1
            if held:
                yield as_batch(list(zip(*held, strict=True)), arrow)

    return rows.mapInArrow(write, CHUNKS)


def write_archives(pages: DataFrame, path: str, least: int = LEAST, size: int = CHUNK) -> None:
    """Writes the archives of pages as a chunked record table, ordered by record and chunk in each file."""
    chunked(records(pages, least), size).write.option("compression", "zstd").parquet(path)


class _Record:
    """A record as its chunks come by: headers, then payload bytes by digest and count only."""

    def __init__(self, data: pa.Buffer):
        view = memoryview(data)
        parts = bytes(view[:_HEAD]).split(b"\r\n\r\n", 2)
        if len(parts) < 3:
            parts = bytes(view).split(b"\r\n\r\n", 2)  # a very long URL
        lines = parts[0].decode(errors="replace").split("\r\n")
        self.fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        if lines[0] != "WARC/1.1" or len(parts) < 3:
            raise ValueError(f"not a WARC record: {bytes(view[:80])!r}")
        lacking = {"WARC-Type", "WARC-Record-ID", "WARC-Target-URI", "WARC-Payload-Digest", "X-Page-ID", "X-Payload-Bytes", "Content-Length"} - set(self.fields)
        if lacking:
            raise ValueError(f"a WARC record without {', '.join(sorted(lacking))}: {bytes(view[:80])!r}")
        self.left = int(self.fields["Content-Length"]) - len(parts[1]) - 4
        self.sum, self.bytes, self.tail = hashlib.sha1(), 0, b""
        self.take(view[len(parts[0]) + len(parts[1]) + 8 :])

    def take(self, data: memoryview) -> None:
        n = min(self.left, len(data))
        self.sum.update(data[:n])
        self.bytes += n
        self.left -= n
        self.tail += bytes(data[n:])

    def row(self) -> tuple:
        f = self.fields
        kind, page = f["WARC-Type"], f["X-Page-ID"]
        if self.left or self.tail != _END:
            raise ValueError(f"record {f['WARC-Record-ID']} ends early or late")
        stated, n = f["WARC-Payload-Digest"].removeprefix("sha1:"), int(f["X-Payload-Bytes"])
        if kind == "response":
            digest = base64.b32encode(self.sum.digest()).decode()
            if (digest, self.bytes) != (stated, n):
                raise ValueError(f"record {f['WARC-Record-ID']} has another payload than stated")
        refers = f.get("X-Refers-To-Page")
        return (int(page) if page else None, n, stated, kind, int(refers) if refers else None, f["WARC-Target-URI"], f["WARC-Record-ID"].strip("<>"))


def read_archives(chunks: DataFrame) -> DataFrame:
    """One row per record of a chunked record table; payloads are digested piece by piece and checked against their headers."""
    arrow = arrow_schema(READ)

    def read(batches):
        at = None
        for batch in batches:
            rows = []
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if chunk == 0:
                    if at is not None:
                        rows.append(at.row())
                    at = _Record(data.as_buffer())
                else:
                    at.take(memoryview(data.as_buffer()))
            if rows:
                yield as_batch(list(zip(*rows, strict=True)), arrow)
        if at is not None:
            yield as_batch([[x] for x in at.row()], arrow)

    single = chunks.where("chunks = 1").select("chunk", "data")
    large = chunks.where("chunks > 1").repartition("archive", "record").sortWithinPartitions("archive", "record", "chunk")
    return single.mapInArrow(read, READ).union(large.select("chunk", "data").mapInArrow(read, READ))


def round_trip(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Writes pages to new archives in the shared folder and reads them back."""
    path = scratch_table(pages.sparkSession, "warc")
    write_archives(pages, path, least)
    return read_archives(pages.sparkSession.read.parquet(path))
