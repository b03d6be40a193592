"""Tables made so that what seldom happens in small ones does happen: queries still give the rows of their SQL."""

from datetime import datetime, timedelta
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from tidewatch.functions import automaton
from tidewatch.operators import clustering, lookups, quantised
from tidewatch.plans import enrichments, registry
from tidewatch.session import shared_folder
from tidewatch.sources import feeds

START = datetime(2024, 1, 1)


def same(spark, at, name, **tables):
    """Writes tables to a folder and compares a query's rows over them with DuckDB's."""
    con = duckdb.connect()
    for t, rows in tables.items():
        pq.write_table(rows, f"{at}/{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet'")
    df = registry.queries()[name](spark, str(at))
    got, want = [tuple(r) for r in df.collect()], con.sql(f"SELECT {', '.join(df.columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert sorted(got, key=str) == sorted(want, key=str)
    return got


def log(rows):
    """Events (event_id, user_id, hour, event_type)."""
    return pa.table({
        "event_id": pa.array([r[0] for r in rows], pa.int64()), "user_id": pa.array([r[1] for r in rows], pa.int64()),
        "ts": pa.array([START + timedelta(hours=r[2]) for r in rows], pa.timestamp("us")), "event_type": pa.array([r[3] for r in rows], pa.string()),
        "value": pa.array([float(r[0] % 7) for r in rows]),
    })


def test_copies_of_ids_that_are_taken(spark, tmp_path):
    got = same(spark, tmp_path, "upsert_snapshot", events=log([(1, 0, 0, "click"), (2, 0, 1, "view"), (1000001, 0, 2, "view"), (1000002, 0, 2, "click")]))
    assert sorted(x for x in got if x[0] == 1000001) == [(1000001, 0.0), (1000001, float(1000001 % 7))]


def test_users_idle_at_the_end_of_the_log(spark, tmp_path):
    same(spark, tmp_path, "stream_idle_state", events=log([(i, u, h, "view") for i, (u, h) in enumerate([(1, 0), (1, 3), (2, 5), (3, 200), (4, 500)])]))


def test_users_first_seen_far_apart(spark, tmp_path):
    same(spark, tmp_path, "stream_idle_gaps", events=log([(i, u, h, "view") for i, (u, h) in enumerate([(0, 0), (1, 1), (2, 90), (4, 300), (5, 700), (8, 719), (0, 719)])]))


def test_copies_make_no_clusters_among_planted_vectors():
    """Of few different vectors, many times each, only the tight groups are clusters that pass the gates, and each is whole."""
    some = np.random.default_rng(1).standard_normal((3, 64))
    some /= np.linalg.norm(some, axis=1, keepdims=True)
    groups = np.arange(960) % enrichments._GROUPS
    texts = [f"p{g}x {i} " + " ".join(f"{x:.5f}" for x in some[i // 16 % 3]) for i, g in enumerate(groups)]
    x = np.array(enrichments._planted_vectors(texts))
    labels, found = clustering.hdbscan_labels(x), []
    for k in range(labels.max() + 1):
        own, total = labels == k, x[labels == k].sum(axis=0)
        if own.sum() >= 6 and (total @ total - (x[own] ** 2).sum()) / (own.sum() * (own.sum() - 1)) >= clustering.MIN_COHESION:
            found.append((set(groups[own]), own.sum()))
    assert found == [({g}, 60) for g in range(enrichments._TIGHT)]


def test_pages_of_a_long_history_share_partitions():
    """All rows of all pages, in partitions of a few pages each where there are many."""
    pages = {"2020": 901, "2021": 1, "2022": 310}

    def fetch(since, until, page):
        return [(since, f"{page}-{k}") for k in range(2)] if page < pages[since[:4]] else []

    source = feeds.history_source("long_history", fetch, "source string, url string")({"since": "2020-02-01", "until": "2022-03-01", "per_page": "2"})
    reader = source.reader(source.schema())
    parts = reader.partitions()
    rows = [r for p in parts for r in reader.read(p)]
    assert feeds.PARTS <= len(parts) < 2 * feeds.PARTS and len(rows) == len(set(rows)) == 2 * sum(pages.values())


def test_history_of_many_orders_a_day(spark, tmp_path):
    n = 12_000
    days = [datetime(1995 + i % 2, 1 + i % 11, 1 + i % 3) for i in range(n)]
    orders = pa.table({"o_orderkey": pa.array(range(n), pa.int64()), "o_orderdate": pa.array(days, pa.timestamp("us"))})
    files = lambda: set(Path(shared_folder(spark).removeprefix("file:")).glob("history-*/year=*/*/part-*"))
    before = files()
    assert len(same(spark, tmp_path, "paged_history", orders=orders)) == n
    assert len(files() - before) == 4  # a file holds a hundred pages


def test_names_are_looked_for_in_their_order(spark, monkeypatch):
    """A text that has one of the first names is not searched for later ones; equal names count once."""
    monkeypatch.setattr(lookups, "SHARD", 400)
    names = [(i, f"n{i:05d}", float(i), 0.0) for i in range(1500)]
    again = [(5000 + i, f"n{i:05d}", -1.0, 0.0) for i in range(1500)]
    table = spark.createDataFrame(again + names, "ord int, name string, lat double, lon double")
    searched, first_of = [], automaton.first_of
    monkeypatch.setattr(automaton, "first_of", lambda x, words: searched.append(len(words)) or first_of(x, words))
    texts = [(i, f"N{99 - i:05d} n{i + 3:05d}") for i in range(50)]
    got = {r.id: r.lat for r in lookups.first_in_text(spark.createDataFrame(texts, "id int, t string"), "t", table).collect()}
    assert got == {i: float(min(99 - i, i + 3)) for i, _ in texts} and len(searched) == 1
    searched.clear()
    late = [(100, "n01499 n01400"), (101, "none"), (102, None)]
    got = {r.id: r.lat for r in lookups.first_in_text(spark.createDataFrame(texts + late, "id int, t string"), "t", table).collect()}
    assert got == {**{i: float(min(99 - i, i + 3)) for i, _ in texts}, 100: 1400.0, 101: None, 102: None} and sum(searched) == 1500


def test_a_whole_search_makes_no_candidates(spark, tmp_path, monkeypatch):
    """Where all rows are kept, a query has no row for each of them: it leaves a block with its nearest ones."""
    x = np.random.default_rng(5).standard_normal((300, 8)).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<float>")
    index = quantised.create(rows, "id", "v", str(tmp_path / "index"), buckets=2)
    index.remove(rows.where("id % 7 = 0").select("id"))
    monkeypatch.setattr(quantised.Stored, "candidates", lambda *args: 1 / 0)
    found = index.search(rows.where("id < 20"), "id", "v", 5, len(index.model.centres), 1 << 30, (64, 8)).collect()
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    left = [i for i in range(300) if i % 7]
    want = {(q, i) for q in range(20) for i in sorted(left, key=lambda i, q=q: (-np.round(unit[q] @ unit[i], 9), i))[:5]}
    assert {(r["query"], r["id"]) for r in found} == want


def test_pages_of_the_collection_lie_in_small_files(spark, tmp_path):
    """What a call to the service reads does not grow with the number of pages."""
    n = 6_600
    pages = pa.table({"page_id": pa.array(range(n), pa.int64()), "html": [f"<p>text of page {i} that is long enough to be kept, and has a table of {i * 7} rows</p>" for i in range(n)]})
    files = lambda: set(Path(shared_folder(spark).removeprefix("file:")).glob("bodies-*/bin=*/part-*"))
    before = files()
    assert len(same(spark, tmp_path, "collected_articles", pages=pages)) > n / 3
    lines = [f.read_text().count("\n") for f in files() - before]
    assert sum(lines) == n and max(lines) <= 64


def test_blocks_of_density_clusters_are_written_once(spark):
    """However many blocks a group has, each stage writes a row once; labels are those of all points at once."""
    x = np.random.default_rng(8).standard_normal((300, 4)).round(2)
    x[100:] += 10 * (np.arange(200)[:, None] % 5)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "article_id int, embedding array<double>")
    folders = lambda: set(Path(shared_folder(spark).removeprefix("file:")).glob("blocks-*"))
    before = folders()
    found = {r.article_id: r.cluster_id for r in clustering.hdbscan(rows, block=32).collect()}
    assert [found[i] for i in range(300)] == clustering.hdbscan_labels(x).tolist()
    assert [sum(pq.ParquetFile(f).metadata.num_rows for f in at.rglob("*.parquet")) for at in folders() - before] == [300, 300]
