import json
import zipfile
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidewatch.sources import config, feeds, schemas, sinks

RSS = """<?xml version="1.0"?><rss><channel><title>feed</title>
<item><title>First - Daily</title><link>https://x/1</link><guid>g1</guid><pubDate>Mon, 03 Jun 2024 10:20:30 GMT</pubDate><source url="https://d">Daily</source></item>
<item><title>Second</title><guid>https://x/2</guid><source url="https://d">Daily</source></item>
<item><title>None</title></item></channel></rss>"""


def test_rss(spark, tmp_path):
    (tmp_path / "a.xml").write_text(RSS)
    (tmp_path / "b.xml").write_text("<rss><broken")
    rows = {r.url: r for r in feeds.rss_items(spark, str(tmp_path)).collect()}
    assert set(rows) == {"https://x/1", "https://x/2"}
    assert rows["https://x/1"].title == "First" and str(rows["https://x/1"].published_at) == "2024-06-03 10:20:30"


def test_resolution(spark):
    rows = spark.createDataFrame([("a",), ("b",), (None,), ("boom",)], "url string")

    def resolver(x):
        if x == "boom":
            raise OSError
        return {"a": "https://a"}.get(x)

    assert [tuple(r) for r in feeds.resolve(rows, "url", resolver).collect()] == [("a", "https://a")]
    lookup = spark.createDataFrame([("b", "https://b")], "url string, canonical_url string")
    assert [tuple(r) for r in feeds.resolve_by(rows, "url", lookup).collect()] == [("b", "https://b")]


def test_ndjson(spark, tmp_path):
    (tmp_path / "s" / "deep").mkdir(parents=True)
    lines = [{"url": "u1", "title": "one"}, {"url": "u1", "title": "again"}, {"url": "u2", "title": "", "body": " "}, {"url": "u3", "body": "text"}]
    (tmp_path / "s" / "1.ndjson").write_text("\n".join([json.dumps(lines[0]), "", "{broken", *map(json.dumps, lines[1:])]))
    (tmp_path / "s" / "deep" / "2.ndjson").write_text(json.dumps({"url": "u1", "title": "later"}))
    rows = {r.url: r for r in feeds.raw_records(spark, str(tmp_path)).collect()}
    assert set(rows) == {"u1", "u3"} and rows["u1"].title == "one" and len(rows["u1"].id) == 32


def export_line(event, country="GR", root="14", code="1413", columns=61):
    line = [""] * columns
    values = {0: event, 1: "20240603", 26: code, 28: root, 30: "-6.5", 31: "4", 34: "x", 52: "Volos", 53: country, 56: "39.3", 57: "22.9", 60: "https://u"}
    for k, v in values.items():
        if k < columns:
            line[k] = v
    return "\t".join(line)


@pytest.mark.parametrize("zipped", [False, True])
def test_exports(spark, tmp_path, zipped):
    text = "\n".join([export_line("1"), export_line("1"), export_line("2", "FR"), export_line("3", root="05"), export_line("4", columns=40), export_line("5", code="1899")])
    if zipped:
        with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
            z.writestr("a.csv", text)
    else:
        (tmp_path / "a.csv").write_text(text)
    rows = {r.event_id: r for r in (feeds.zipped_exports if zipped else feeds.event_exports)(spark, str(tmp_path)).collect()}
    assert set(rows) == {"1", "5"} and rows["1"].category_hint == "labor_economic" and rows["5"].category_hint == "conflict"
    assert rows["1"].published_on == date(2024, 6, 3) and rows["1"].avg_tone is None and rows["1"].num_mentions == 4


def test_article_lists(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"articles": [{"url": "u", "title": " a  b ", "seendate": "20240603T102030Z"}, {"url": "u"}, {"url": " "}]}))
    rows = feeds.article_lists(spark, str(tmp_path)).collect()
    assert [(r.url, r.title, str(r.published_at)) for r in rows] == [("u", "a b", "2024-06-03 10:20:30")]


def test_windows_and_years():
    files = feeds.export_files(datetime(2024, 1, 1, 0, 15), 1, "b/")
    assert files[0] == "b/20240101001500.export.CSV.zip" and len(files) == 4 and files[-1].startswith("b/202312312330")
    assert feeds.years(date(2022, 5, 1), date(2024, 6, 1)) == [(date(2022, 5, 1), date(2022, 12, 31)), (date(2023, 1, 1), date(2023, 6, 2))]
    assert feeds.years(date(2024, 1, 1), date(2024, 6, 1)) == []


def test_paged_source(spark):
    spark.dataSource.register(feeds.paged_source("numbers", lambda page: [(f"p{page}", str(i)) for i in range(3 if page < 2 else 1)], "source string, url string"))
    rows = spark.read.format("numbers").option("pages", "3").load()
    assert rows.count() == 7 and rows.rdd.getNumPartitions() == 3


def test_caps_then_first(spark):
    rows = spark.createDataFrame([("k1", i, f"u{i % 5}") for i in range(20)] + [("k2", i, f"u{i}") for i in range(3)], "kw string, pos int, url string")
    capped = feeds.capped(rows, "kw", ["pos"], 4)
    assert capped.count() == 7 and feeds.first_by(capped, ["url"], ["pos", "kw"]).count() == 4


def test_config(spark, tmp_path):
    (tmp_path / "k.yml").write_text("# words\na:\n  - one\n  - 'two three'\n\nb:\n  - four # last\n")
    assert config.keyword_groups(str(tmp_path / "k.yml")) == {"a": ["one", "two three"], "b": ["four"]} and config.keywords(str(tmp_path / "k.yml"))[-1] == "four"
    (tmp_path / "g.yml").write_text('# towns\n"Βόλος":  {lat: 39.3, lon: 22.9}\n"Λάρισα": {lat: 39.6, lon: -22.4}\n')
    assert [tuple(r) for r in config.gazetteer(spark, str(tmp_path / "g.yml")).orderBy("ord").collect()] == [(0, "βόλος", 39.3, 22.9), (1, "λάρισα", 39.6, -22.4)]
    (tmp_path / "p.json").write_text(json.dumps({"features": [{"geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1], [0, 0]]]]}}]}))
    assert len(config.polygon(spark, str(tmp_path / "p.json")).first().rings[0]) == 4
    assert config.model_choice(None, [("", "a"), ("key", "b")], "c") == "b" and config.model_choice("x", [("key", "b")], "c") == "x" and config.model_choice(None, [], "c") == "c"


def test_insert_new(spark):
    stored = spark.createDataFrame([("h0", "u0")], "content_hash string, canonical_url string")
    batch = [(1, "h1", "u1"), (2, "h1", "u2"), (3, "h3", "u1"), (4, "h0", "u4"), (5, "h5", "u0"), (6, "h6", "u2")]
    rows = spark.createDataFrame(batch, "pos int, content_hash string, canonical_url string")
    assert sorted(r.pos for r in sinks.insert_new(rows, stored, ["pos"]).collect()) == [1, 6]


def test_archive_snapshots_and_runs(spark, tmp_path):
    rows = spark.createDataFrame([("s", "2024-06-03T10:00:00", "a"), ("s", "2024-06-04T10:00:00", "b")], "source string, scraped_at string, url string")
    sinks.archive(rows, str(tmp_path / "raw"))
    sinks.archive(rows, str(tmp_path / "raw"))
    assert (tmp_path / "raw" / "source=s" / "dt=2024-06-03").is_dir() and spark.read.json(str(tmp_path / "raw")).count() == 4
    assert sinks.load_snapshot(spark, str(tmp_path / "none"), "a int").count() == 0
    sinks.snapshot(spark.range(3).select(F.col("id").cast("int").alias("a")), str(tmp_path / "snap"))
    assert sinks.load_snapshot(spark, str(tmp_path / "snap"), "a int").count() == 3
    for run in ("r1", "r2"):
        sinks.append_run(spark, str(tmp_path / "runs"), run, datetime(2024, 1, 1), datetime(2024, 1, 2), {"theta": 0.85}, {"events": 2})
    assert spark.read.schema(schemas.RUN).parquet(str(tmp_path / "runs")).where("metrics['events'] = 2").count() == 2
    sinks.export_json(rows, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
