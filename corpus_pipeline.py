"""From raw documents to a training mix: five stages, each over all that the one before it kept.

Defined cases: null, empty and blank texts fail the quality rules and go; a row is known by its doc_id and text, so that repeated rows go together or
stay together where copies are no matter, and of near duplicates one row stays; ties are broken by doc_id, null first where it is an id; columns of any name pass
through, but for those that the last stage adds in their place; an empty table stays empty through all stages. Each stage's module says the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import decontaminate, mixing, neardup, quality_rules, secrets
from tidewatch.llm.shared import scratch_table, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_rules.keep_good(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, similarity 0.8), the one with the smallest doc_id."""
    return neardup.one_of_each(docs)


def untainted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontaminate.without_overlaps(docs, table(spark, sf_dir, "benchmark"))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked."""
    return secrets.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes words of, with those words (repeats counted), their size and their source's target, in place of columns of these names."""
    return mixing.mixed_rows(docs)


STAGES = [
    ("quality_rules", good),
    ("simhash", distinct),
    ("decontamination", untainted),
    ("secrets", clean),
    ("mixing", mixed),
]
#: No SQL: min-hashes, spaced-seed hashes and the seeded order are not SQL functions; every stage has a brute-force test.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_table(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
