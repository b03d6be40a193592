"""The native operator runs no Python, and the others' wide steps are those that are meant."""

from tidewatch.llm import decontaminate, quality_rules, secrets
from tidewatch.llm.shared import table

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_decontamination_is_native(spark):
    docs, bench = table(spark, SF, "documents"), decontaminate.items(table(spark, SF, "benchmark"))
    rows = docs.withColumn("key", decontaminate.row_key(decontaminate.row_sig()))
    for df in (decontaminate.hits(rows, bench), decontaminate.overlaps(docs, table(spark, SF, "benchmark")), decontaminate.without_overlaps(docs, table(spark, SF, "benchmark"))):
        text = plan(df)
        assert not any(x in text for x in ("Python", "Arrow", "Pandas", "CartesianProduct"))
    assert "BroadcastHashJoin" in plan(decontaminate.hits(rows, bench))


def test_row_wise_operators_do_not_shuffle(spark):
    docs = table(spark, SF, "documents")
    for df in (quality_rules.quality_rules(docs), quality_rules.keep_good(docs), secrets.scan(docs), secrets.redact(docs)):
        assert "Exchange" not in plan(df)


def test_large_benchmarks_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs, bench = table(spark, SF, "documents"), table(spark, SF, "benchmark")
        small = {tuple(r) for r in decontaminate.overlaps(docs, bench).select("doc_id", "item_id", "n_matched").collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    monkeypatch.undo()
    assert small and small == {tuple(r) for r in decontaminate.overlaps(docs, bench).select("doc_id", "item_id", "n_matched").collect()}
