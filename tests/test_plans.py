"""Shapes of plans: what is read, what is pushed down, what is shuffled."""

import re

from tidewatch.plans import registry

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    return registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(spark, "list_events_filtered")
    assert "GreaterThanOrEqual(o_orderdate" in text and "EqualTo(o_orderpriority,1-URGENT)" in text
    assert not re.search(r"ReadSchema: [^\n]*o_totalprice", text) and "TakeOrderedAndProject" in text


def test_distribution_is_one_shuffle_with_partial_counts(spark):
    text = plan(spark, "stats_document")
    assert text.count("Exchange hashpartitioning") == 1 and "partial_count" in text and text.count("FileScan") == 1


def test_vectors_are_not_read_for_counts(spark):
    schemas = re.findall(r"ReadSchema: (\S+)", plan(spark, "existing_ids"))
    assert schemas and not any("embedding" in s for s in schemas)


def test_lookups_need_no_shuffle(spark):
    for name in ("gazetteer_first_match", "pair_lookup", "taxonomy_labels", "polygon_contains", "relevance_keyword", "html_extract"):
        text = plan(spark, name)
        assert "Exchange" not in text and "Python" not in text, name


def test_registry_sends_clusters_to_events(spark):
    text = plan(spark, "registry_match")
    assert "BroadcastNestedLoopJoin BuildRight" in text and "SortMergeJoin" not in text


def test_semi_join_of_ids(spark):
    assert re.search(r"(Broadcast|SortMerge|ShuffledHash)\w*Join .*LeftSemi", plan(spark, "existing_ids"))
