"""WARC records that are damaged, and archives of many repeated payloads."""

import pytest
from pyspark.errors import PythonException

from tidewatch.llm import warc


def chunks(spark, data):
    return spark.createDataFrame([(0, 0, 0, 1, bytearray(data))], warc.CHUNKS)


@pytest.mark.parametrize(("data", "says"), [
    (b"HTTP/1.1 200 OK\r\n\r\nno record", "not a WARC record"),
    (b"", "not a WARC record"),
    (b"WARC/1.1\r\nWARC-Type: response\r\n\r\nHTTP/1.1 200 OK\r\n\r\nx\r\n\r\n", "a WARC record without"),
])
def test_foreign_records_say_what_they_are(spark, data, says):
    with pytest.raises(PythonException, match=says):
        warc.read_archives(chunks(spark, data)).collect()


def test_cut_records_are_refused(spark):
    pages = spark.createDataFrame([(1, "u", "some payload")], "page_id long, url string, html string")
    whole = bytes(warc.chunked(warc.records(pages)).first().data)
    assert warc.read_archives(chunks(spark, whole)).first().payload_bytes == 12
    for damaged in (whole[:-3], whole + b"x", whole.replace(b"some payload", b"same payload")):
        with pytest.raises(PythonException, match="ends early or late|another payload"):
            warc.read_archives(chunks(spark, damaged)).collect()


@pytest.mark.parametrize("least", [0, 5])
def test_many_repeated_digests_give_the_same_archives(spark, monkeypatch, least):
    rows = [(i if i % 9 else None, f"u{i}", ["", "abc", "long payload", None, f"own{i}"][i % 5]) for i in range(60)]
    pages = spark.createDataFrame([*rows, (1, "again", "abc")], "page_id long, url string, html string")
    shown = lambda: sorted(map(str, warc.round_trip(pages, least).collect()))
    few = shown()
    monkeypatch.setattr(warc, "BROADCAST", 0)
    assert shown() == few and len(few) == 61


def test_a_payload_above_a_megabyte_in_chunks(spark):
    pages = spark.createDataFrame([(1, "u", "é" * 900_000), (2, "v", "é" * 900_000), (3, "w", "x")], "page_id long, url string, html string")
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()}
    assert got == {1: (1_800_000, "response", None), 2: (1_800_000, "revisit", 1), 3: (1, "response", None)}
