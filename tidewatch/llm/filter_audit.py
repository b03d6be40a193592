"""Operator 13: how five filters interact, by the multilinear extension of what they remove.

Each document has a mask of the filters that it fails. A part's counts by mask form its removal polynomial: with x_i the share of
filter i that is applied, a mask m is removed by 1 minus the product of (1 - x_i) over i in m. Corners of the polynomial give
what any set of filters removes, hence what is left after each step of each order; the integral of a partial derivative along the
diagonal, in exact rationals, is the filter's Shapley value, which times 120 is its removals summed over all orders.

Masks are column expressions and counts are partial sums: what moves is (doc_id, part, digest, mask), first summed where it
lies. A repeated text is one group of its parts and masks, never of its documents, so a text that a third of all
rows hold is no hot group. One row of at most 32 masks a part reaches the polynomial.

Defined cases: null text is empty text (both are one text); null source is the part ''; of rows that share the smallest doc_id of
a text none fails E; rows without a doc_id neither fail E nor make others fail it, and have no labels; a document is good (toxic) if any row
of labels says so; repeated rows count each; other columns are ignored; an empty table gives no part.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
SCHEMA = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
    "good_lost long, toxic_lost long, shapley long"
)


def text_mask(text: Column) -> Column:
    """Bits 0 to 3 for failing A to D."""
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    # One struct of both counts, so that the words are cut once.
    counted = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("own")))[0]
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    fails = F.transform(
        F.array(counted),
        lambda c: F.when(c["n"] < LEAST_WORDS, 1).otherwise(0) + F.when(c["own"].cast("long") * 100 < c["n"].cast("long") * LEAST_DISTINCT, 2).otherwise(0),
    )[0]
    return fails + F.when(capitals.cast("long") * 100 > F.length(text).cast("long") * MOST_CAPITALS, 4).otherwise(0) + F.when(text.rlike("[#$%&*|]"), 8).otherwise(0)


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (0 to 31), and how many documents, good and toxic ones have it."""
    known = F.col("doc_id").isNotNull()
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.when(known, F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))).alias("digest"),
        text_mask(F.col("text")).alias("mask"),
    )
    rows = rows.groupBy("doc_id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n"))
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    flag = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
    said = said.agg(flag("quality"), flag("toxic"))
    rows = rows.join(said, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("quality", "toxic")})
    rows = rows.groupBy("digest", "part", "mask", "quality", "toxic").agg(
        F.min("doc_id").alias("low"), F.min_by("n", "doc_id").alias("n_low"), F.sum("n").alias("n")
    )
    # A text's rows are its parts and labels now, whatever the number of its documents.
    first = F.col("low") == F.min("low").over(Window.partitionBy("digest"))
    alone = F.when(F.col("digest").isNull(), F.col("n")).when(first, F.col("n_low")).otherwise(0)
    rows = rows.withColumn("alone", alone)
    pair = F.array(F.struct(F.col("mask"), F.col("alone").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("alone")).alias("n")))
    rows = rows.select("part", "quality", "toxic", F.explode(pair).alias("m")).select("part", "quality", "toxic", "m.mask", "m.n").where("n > 0")
    return rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("quality")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


class RemovalPolynomial:
    """1 - product of (1 - x_i) over each mask's filters, summed with the masks' counts, as coefficients of the products of x_i."""

    def __init__(self, counts: dict[int, int], filters: int = len(FILTERS)):
        self.filters = filters
        self.total = sum(counts.values())
        self.terms: dict[int, int] = {}
        for mask, n in counts.items():
            part = mask
            while part:
                sign = 1 if part.bit_count() % 2 else -1
                self.terms[part] = self.terms.get(part, 0) + sign * n
                part = (part - 1) & mask

    def corner(self, applied: int) -> int:
        """What a set of filters removes."""
        return sum(c for part, c in self.terms.items() if part & applied == part)

    def shapley(self, i: int) -> Fraction:
        """The integral from 0 to 1 of the partial derivative by x_i at (t, ..., t)."""
        return sum((Fraction(c, part.bit_count()) for part, c in self.terms.items() if part >> i & 1), Fraction(0))


def part_rows(part: str, counts: list[tuple[int, int, int, int]]) -> list[tuple]:
    """The report of one part, from (mask, documents, good ones, toxic ones)."""
    whole, good, toxic = (RemovalPolynomial({c[0]: c[k] for c in counts}) for k in (1, 2, 3))
    every = (1 << len(FILTERS)) - 1
    corners = [[p.corner(s) for s in range(every + 1)] for p in (whole, good, toxic)]
    out = []
    values = [whole.shapley(i) * 120 for i in range(len(FILTERS))]
    if any(v.denominator != 1 for v in values):
        raise ArithmeticError(f"part {part!r}: a sum over orders is no whole number")
    for order in permutations(range(len(FILTERS))):
        name, done = "".join(FILTERS[i] for i in order), 0
        for step, i in enumerate(order, 1):
            now = done | 1 << i
            removed, good_lost, toxic_lost = (c[now] - c[done] for c in corners)
            fails, unique = corners[0][1 << i], corners[0][every] - corners[0][every ^ 1 << i]
            out.append((part, name, step, whole.total - corners[0][now], removed, fails - removed, unique, good_lost, toxic_lost, int(values[i])))
            done = now
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For each part, each of the 120 orders of the filters and each step: what is kept, removed, redundant and lost."""
    counts = masks(docs, labels)
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))  # at most 32 entries
    columns = [c.split()[0] for c in SCHEMA.split(", ")]

    def report(frames):
        for frame in frames:
            for part, entries in zip(frame["part"], frame["counts"], strict=True):
                yield pd.DataFrame(part_rows(part, [(e["mask"], e["n"], e["good"], e["toxic"]) for e in entries]), columns=columns)

    return parts.mapInPandas(report, SCHEMA)
