"""Approximate nearest vectors by cosine: cells around centres, of which a search looks at the nearest few.

The centres, and how many cells a search looks at, are fitted on a bounded sample; every row is indexed. Rows and queries of a cell are
dealt to blocks that meet in pairs, so a cell that holds a third of all rows is many tasks. Rows without a vector are not indexed,
zero vectors have similarity 0 with all, and vectors of different lengths are an error.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import matrix

#: Rows that centres are fitted on, and cells, at most: what the driver and every task hold.
SAMPLE, CELLS = 20_000, 1_024
#: Rows and queries of a block; queries of the sample that the number of cells to look at is fitted on.
ROWS, QUERIES, TRIED = 8_192, 4_096, 512
#: The share of true neighbours that a search is to find.
RECALL = 0.95


@dataclass(frozen=True)
class Index:
    """rows: key, v, cell. probes: cells that a search looks at unless told otherwise."""

    rows: DataFrame
    key: str
    centres: np.ndarray
    probes: int


def _unit(column) -> np.ndarray:
    x = matrix(column)
    length = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(length > 0, length, 1)


def _centres(x: np.ndarray, n: int, rounds: int = 12) -> np.ndarray:
    """Unit centres of n groups, each the mean direction of the rows nearest to it; an empty one stays where it was."""
    centres = x[np.linspace(0, len(x) - 1, n).astype(int)].copy()
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        length = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(length > 0, sums / np.where(length > 0, length, 1), centres)
    return centres


def _probes(x: np.ndarray, centres: np.ndarray, k: int, recall: float) -> int:
    """The cells to look at so that, within the sample, the share of k nearest rows is found."""
    dots = x @ centres.T
    own, ranks = dots.argmax(axis=1), []
    for i in range(min(len(x), TRIED)):
        near = np.argsort(-(x @ x[i]), kind="stable")
        near = near[near != i][:k]
        ranks.append((dots[i][:, None] > dots[i][own[near]]).sum(axis=0))
    found = np.sort(np.concatenate(ranks)) if ranks else np.zeros(1)
    return int(found[math.ceil(recall * len(found)) - 1]) + 1 if len(found) else 1


def _placed(df: DataFrame, key: str, centres: np.ndarray, probes: int) -> DataFrame:
    """(key, v, cell): a row for each of the nearest cells of a vector."""
    kinds = dict(df.dtypes)

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            x = _unit(batch.column(1))
            dots = x @ centres.T if centres.size else np.zeros((len(x), 1))  # an index without rows
            cells = np.argsort(-dots, axis=1, kind="stable")[:, :probes].astype(np.int32)
            at = pa.array(np.repeat(np.arange(len(x)), cells.shape[1]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(cells.ravel())], names=[key, "v", "cell"])

    return df.mapInArrow(run, f"{key} {kinds[key]}, v {kinds['v']}, cell int")


def _vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    return df.where(F.col(vector).isNotNull()).select(key, F.col(vector).alias("v"))


def build(df: DataFrame, key: str, vector: str, k: int = 10, sample: int = SAMPLE, cells: int = CELLS, recall: float = RECALL) -> Index:
    """An index of all rows. The sample is that of the smallest hashes of keys, so that it does not depend on partitions; it is taken
    to the driver, `sample` rows at most. There are as many cells as the square root of the sampled rows, `cells` at most."""
    rows = _vectors(df, key, vector)
    taken = rows.orderBy(F.xxhash64(F.col(key).cast("string")), key).limit(sample).select("v").toArrow()["v"]
    if not len(taken):
        return Index(_placed(rows, key, np.zeros((1, 0)), 1), key, np.zeros((1, 0)), 1)
    x = _unit(taken)
    centres = _centres(x, max(1, min(cells, math.isqrt(len(x)))))
    return Index(_placed(rows, key, centres, 1), key, centres, _probes(x, centres, k, recall))


def _meeting(rows: DataFrame, asked: DataFrame, sizes: tuple[int, int], kernel, schema: str) -> DataFrame:
    """What a kernel gives for every block of a cell's rows (__id, cell, ...) with every block of the queries (query, cell, ...) that look at the cell."""
    counts = rows.groupBy("cell").agg(F.ceil(F.count("*") / sizes[0]).cast("int").alias("a")).join(asked.groupBy("cell").agg(F.ceil(F.count("*") / sizes[1]).cast("int").alias("b")), "cell")
    known = counts.select("cell", "a", "b")  # a row a cell, of which there are CELLS at most

    def dealt(side: DataFrame, id: str, own: str, other: str) -> DataFrame:
        both = side.join(F.broadcast(known), "cell")
        mine = F.pmod(F.xxhash64(id), F.col(own)).cast("int").alias(f"__{own}")
        return both.select(*side.columns, mine, F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(f"__{other}"))

    names = ["cell", "__a", "__b"]
    return dealt(rows, "__id", "a", "b").groupBy(*names).cogroup(dealt(asked, "query", "b", "a").groupBy(*names)).applyInArrow(kernel, schema)


def search(index: Index, queries: DataFrame, key: str, vector: str, k: int = 10, probes: int | None = None, sizes: tuple[int, int] = (ROWS, QUERIES)) -> DataFrame:
    """(query, key, similarity): the k nearest rows of each query among its nearest cells, rounded to 9 places, the smaller key first
    on ties. With as many probes as cells it is exact."""
    probes = min(probes or index.probes, len(index.centres))
    asked = _placed(_vectors(queries, key, vector).withColumnRenamed(key, "query"), "query", index.centres, probes)
    rows = index.rows.withColumnRenamed(index.key, "__id")
    kinds = dict(asked.dtypes)["query"], dict(rows.dtypes)["__id"]

    def near(t: pa.Table, q: pa.Table) -> pa.Table:
        ids, found, sims = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        if len(t) and len(q):
            t = t.sort_by("__id")
            x, y = _unit(t["v"]), _unit(q["v"])
            for i in range(0, len(y), 256):
                s = np.round(y[i : i + 256] @ x.T, 9)
                top = np.argsort(-s, axis=1, kind="stable")[:, :k]
                ids.append(np.repeat(np.arange(i, i + len(s)), top.shape[1])), found.append(top.ravel()), sims.append(np.take_along_axis(s, top, 1).ravel())
        return pa.table({"query": q["query"].take(pa.array(np.concatenate(ids))), "__id": t["__id"].take(pa.array(np.concatenate(found))), "similarity": np.concatenate(sims)})

    met = _meeting(rows, asked, sizes, near, f"query {kinds[0]}, __id {kinds[1]}, similarity double")
    order = Window.partitionBy("query").orderBy(F.desc("similarity"), "__id")
    return met.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= k).select("query", F.col("__id").alias(index.key), "similarity")


def recall(found: DataFrame, exact: DataFrame, key: str) -> DataFrame:
    """One row: the share of exact neighbours (query, key) that are found."""
    hit = found.select("query", key).withColumn("__hit", F.lit(1.0))
    return exact.select("query", key).join(hit, ["query", key], "left").agg(F.avg(F.coalesce("__hit", F.lit(0.0))).alias("recall"))
