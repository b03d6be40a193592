"""Paged histories with few calls; quarter-hourly exports: stamps, packed files, and a stream that is stopped, begun again and finds a gap."""

import io
import zipfile
from datetime import datetime

from tidewatch.sources import exports, feeds
from tidewatch.streaming import cycle


def test_quarters():
    assert exports.quarters("20240229233000", "20240301001500") == ["20240229234500", "20240301000000", "20240301001500"]
    assert exports.quarters("20240301001500", "20240301001500") == [] and exports.quarter(datetime(2024, 1, 1, 5, 44, 59)) == datetime(2024, 1, 1, 5, 30)


def test_restart_neither_loses_nor_repeats(spark, tmp_path):
    (tmp_path / "in").mkdir()
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("x.CSV", "p1\r\np2\n")
    (tmp_path / "in" / "20240101001500.export.CSV.zip").write_bytes(packed.getvalue())
    (tmp_path / "in" / "20240101003000.export.CSV").write_text("a\nb\n")
    (tmp_path / "in" / "20240101010000.export.CSV").write_text("c\n")  # a quarter hour has no file
    spark.dataSource.register(exports.export_source("folder_exports", exports.in_folder(str(tmp_path / "in"))))

    def run(until):
        out = cycle.run_to(exports.stream(spark, "folder_exports", "20240101000000", until), str(tmp_path / "table"), str(tmp_path / "checkpoint"))
        return sorted((r.file[8:12], r.line, r.value) for r in out.collect())

    first = [("0015", 0, "p1"), ("0015", 1, "p2")]
    assert run("20240101001500") == first
    assert run("20240101001500") == first
    rest = [("0030", 0, "a"), ("0030", 1, "b"), ("0100", 0, "c")]
    assert run("20240101010000") == first + rest
    (tmp_path / "in" / "20240101011500.export.CSV").write_text("d\n")
    assert run("20240101011500") == [*first, *rest, ("0115", 0, "d")]


def test_pages_are_found_with_few_calls():
    for n in (*range(40), 100, 1023, 1024, 5000):
        asked = []
        assert feeds.last_page(lambda page, n=n, asked=asked: asked.append(page) or page < n) == n
        assert len(asked) <= 2 * (n + 1).bit_length() + 1 and len(set(asked)) == len(asked)


def test_history_is_read_once(spark, tmp_path):
    """Every page is read by one task, the planner asks few times, and no row is lost or given twice."""
    log, rows = tmp_path / "calls", {"2020": 95, "2021": 0, "2022": 30, "2023": 1}

    def fetch(since, until, page):
        with open(log, "a") as f:
            f.write(f"{since} {until} {page}\n")
        return [(since[:4], str(i)) for i in range(10 * page, min(rows[since[:4]], 10 * page + 10))]

    spark.dataSource.register(feeds.history_source("history_for_test", fetch, "source string, url string"))
    got = spark.read.format("history_for_test").option("since", "2020-05-01").option("until", "2023-02-03").option("per_page", "10").load().collect()
    assert sorted((r.source, int(r.url)) for r in got) == [(y, i) for y, n in rows.items() for i in range(n)]
    calls = log.read_text().split("\n")[:-1]
    pages = sum(n // 10 + 1 for n in rows.values())
    assert pages < len(calls) <= pages + 2 * sum(2 * (n // 10 + 1).bit_length() + 1 for n in rows.values())  # a plan may be made twice
    assert {c.split()[0] for c in calls} == {"2020-05-01", "2021-01-01", "2022-01-01", "2023-01-01"} and "2023-01-01 2023-02-03 0" in calls
