"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewatch.llm import cotrain, decontaminate, langmix, licenses, mixing, quality_rules, secrets, simhash, substring_dedup, warc

CLASHING = ["sig", "key", "fp", "shard", "home", "node", "root", "first", "count", "seed", "hashes", "at", "words", "spans", "size", "taken", "target", "pattern", "label", "starts", "kept", "n_words", "item_id", "diagonal"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n, salt=0):
    return " ".join(f"word{(i * 7919 + salt * 104729) % 100003}" for i in range(n))


ROWS = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \t\n\x0b ", "en", "a", 5),
    (4, "one", "en", "b", 3),
    (5, prose(60), "en", "a", 1),
    (5, prose(60), "en", "a", 1),
    (5, prose(61, 5), "de", None, 1),
    (6, prose(60), "en", "b", 1),
    (None, prose(60), "en", None, None),
    (None, None, "en", "a", 1),
    (7, prose(40, 2) + "\n" + prose(30), "fr", "c", 1),
    (8, "### 123 ² ---", "en", "c", 1),
    (9, prose(20000, 3), "en", "a", 1),
    (10, "éß中 " * 30, "fr", "a", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    return rows.withColumns({c: F.lit("clash") for c in CLASHING})


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def bench(spark):
    text = prose(60).split()
    rows = [(1, " ".join(text[10:40])), (1, " ".join(text[10:40])), (2, None), (3, ""), (4, "one"), (None, " ".join(text[30:50]))]
    return spark.createDataFrame(rows, "item_id long, text string").withColumn("key", F.lit("clash")).withColumn("words", F.lit(1))


def labels(spark):
    return spark.createDataFrame([(5, 1, 0), (6, 1, 0), (8, 0, 0), (4, 0, 1), (99, 1, 0), (None, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int")


def test_rules(docs, none):
    found = {r.doc_id: r for r in quality_rules.quality_rules(docs).collect()}
    assert quality_rules.quality_rules(docs).count() == len(ROWS)
    assert [found[i].n_words for i in (1, 2, 3, 4)] == [0, 0, 0, 1] and all(found[i].base_failed for i in (1, 2, 3, 4))
    assert found[6].kept and found[9].kept and not found[10].kept
    assert quality_rules.quality_rules(none).count() == 0
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 5").count() == 3 and quality_rules.keep_good(none).count() == 0


def test_simhash(docs, none):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(ROWS)
    by = {(r.doc_id, r.sig): r for r in rows}
    assert len(by) == len(ROWS) - 1
    zero = [r for r in rows if r.fingerprint == "0" * 16]
    assert {r.doc_id for r in zero} == {1, 2, 3, None} and {r.component_id for r in zero} == {1}
    assert {r.component_id for r in rows if r.doc_id == 6} == {5}
    stay = simhash.one_of_each(docs)
    ids = sorted((r.doc_id for r in stay.collect()), key=lambda x: (x is None, x))
    assert stay.columns == docs.columns and ids == [1, 4, 5, 5, 7, 8, 9, 10]
    assert simhash.near_duplicates(none).count() == 0 and simhash.one_of_each(none).count() == 0


def test_decontamination(docs, none, bench):
    found = decontaminate.overlaps(docs, bench).select("doc_id", "item_id", "n_matched").collect()
    # Items of a few tokens used to be left out; item 4 now meets the document that holds all of it.
    expected = {(d, i) for d in (5, 6, None) for i in (1, None)} | {(7, 1), (4, 4)}
    assert {(r.doc_id, r.item_id) for r in found} == expected and len(found) == 8
    kept = decontaminate.without_overlaps(docs, bench)
    assert kept.columns == docs.columns and kept.count() == len(ROWS) - 6
    assert decontaminate.without_overlaps(docs, bench.where("false")).count() == len(ROWS)
    assert decontaminate.overlaps(none, bench).count() == 0


def test_secrets(docs, none):
    assert secrets.digest(secrets.scan(docs)).where("spans <> ''").count() == 0
    assert secrets.digest(secrets.scan(docs)).count() == len(ROWS) and secrets.scan(none).count() == 0
    same = secrets.redact(docs)
    assert same.columns == docs.columns and same.exceptAll(docs).count() == 0 and secrets.redact(none).count() == 0


def test_languages(spark, docs, none):
    found = langmix.identify(docs).collect()
    assert len(found) == len(ROWS)
    assert {r.lang_pred for r in found if r.doc_id in (1, 2, 3, 8)} == {"und"}
    assert all(0 <= r.score <= 1 for r in found)
    assert langmix.identify(none).count() == 0
    assert {r.lang_pred for r in langmix.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_licenses(docs, none):
    found = licenses.digest(licenses.scan(docs)).collect()
    assert len(found) == len(ROWS) and not any(r.labels or r.n_base for r in found) and found[0].first_word is None
    assert licenses.scan(none).count() == 0


def test_classifier(spark, docs, none):
    found = cotrain.classify(docs, labels(spark)).collect()
    assert len(found) == len(ROWS) and all(0 <= r.score <= 1 for r in found)
    one = cotrain.classify(docs, labels(spark).where("quality = 1")).collect()
    assert {r.score for r in one} == {1.0}
    assert {r.score for r in cotrain.classify(docs, labels(spark).where("false")).collect()} == {0.5}
    assert cotrain.classify(none, labels(spark)).count() == 0


def test_mixing(docs, none):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(ROWS) and sum(r.size for r in rows) == sum(len((t or "").split()) for _, t, *_ in ROWS)
    assert all(0 <= r.taken <= 3 * r.size for r in rows)
    for source in {r.source for r in rows}:
        own = [r for r in rows if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1
    assert mixing.mix(none).count() == 0
    assert {(r.target, r.taken) for r in mixing.mix(docs.where("doc_id in (1, 2, 3)")).collect()} == {(0.0, 0)}


def test_warc(spark):
    rows = [(1, "u", "x" * 300), (2, None, "x" * 300), (3, "u\r\nv", None), (4, "w", ""), (None, "n", "x" * 300), (5, "l", "é" * 100), (1, "u", "x" * 300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("first", F.lit(1))
    found = warc.round_trip(pages).collect()
    kinds = sorted(((r.page_id, r.record_type, r.refers_to) for r in found), key=repr)
    assert kinds == sorted([(1, "response", None), (1, "response", None), (2, "revisit", 1), (3, "response", None), (4, "revisit", 3), (None, "revisit", 1), (5, "response", None)], key=repr)
    assert warc.round_trip(pages.where("false")).count() == 0
    chunks = warc.chunked(warc.records(pages), 64)
    assert chunks.where("chunks > 1").count() > 8
    assert warc.read_archives(chunks).drop("record_id").exceptAll(warc.read_archives(warc.chunked(warc.records(pages))).drop("record_id")).count() == 0
    assert {r.record_type for r in warc.read_archives(warc.chunked(warc.records(pages, 100))).where("page_id in (3, 4)").collect()} == {"response"}


def test_substrings(docs, none):
    rows = substring_dedup.substring_dedup(docs).collect()
    assert len(rows) == len(ROWS)
    removed = sorted(((r.doc_id, r.n_words, r.n_removed) for r in rows), key=repr)
    text = {(5, 60, 0), (6, 60, 60), (None, 60, 60), (7, 70, 30), (9, 20000, 0)}
    assert text <= set(removed) and [x for x in removed if x[0] == 5] == [(5, 60, 0), (5, 60, 0), (5, 61, 0)]
    assert substring_dedup.substring_dedup(none).count() == 0


def test_stages(spark, docs, none, bench, tmp_path):
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    for rows in (docs, none):
        now = rows
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, now, str(tmp_path))
            if name != "mixing":
                assert out.columns == docs.columns, name
            now = spark.createDataFrame(out.collect(), out.schema)
        assert "taken" in now.columns
