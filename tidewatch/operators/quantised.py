"""A stored index of vectors that is added to: cells, residuals in a byte for each few dimensions, and exact re-ranking.

The model - centres of cells, and 256 words for each part of a residual - is fitted once on a bounded sample and stored; every row is indexed, and later
rows are coded by the same model. A search first scores codes, of which a row has a sixteenth of its vector's bytes, and then computes
exact similarities for the best of these only, whose vectors are joined by key. Rows are a keyed table: they can be added, moved and removed.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.sources.keyed import KeyedTable

from . import dedup, nearest

#: Words of a part, and dimensions of it.
WORDS, PART = 256, 4
#: The share of true neighbours that each of the two cuts is to leave.
LEAVES = 0.99


@dataclass(frozen=True)
class Model:
    """centres: one a cell; books: words of each part; probes: cells that a search looks at; keep: rows of best codes that are compared exactly."""

    centres: np.ndarray
    books: np.ndarray
    probes: int
    keep: int

    @property
    def size(self) -> int:
        return self.centres.shape[1]

    def parts(self, x: np.ndarray) -> np.ndarray:
        """Rows as parts of PART dimensions, the last filled with zeros."""
        m = self.books.shape[0]
        return np.pad(x, ((0, 0), (0, m * PART - x.shape[1]))).reshape(len(x), m, PART)

    def code(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each unit row, and the nearest words of its residual."""
        cell = (x @ self.centres.T).argmax(axis=1)
        rest = self.parts(x - self.centres[cell])
        out = np.empty(rest.shape[:2], np.uint8)
        for j, words in enumerate(self.books):
            out[:, j] = ((words * words).sum(axis=1) - 2 * rest[:, j] @ words.T).argmin(axis=1)
        return cell, out

    def score(self, queries: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Dots of queries with the residuals that codes stand for."""
        tables = np.einsum("qmd,mwd->mqw", self.parts(queries), self.books)
        out = np.zeros((len(queries), len(codes)))
        for j, table in enumerate(tables):
            out += table[:, codes[:, j]]
        return out


def fit(x: np.ndarray, k: int = 10, cells: int = nearest.CELLS, rounds: int = 8) -> Model:
    """A model of unit rows. probes and keep are what leaves most of the k nearest rows within the sample."""
    n = max(1, min(cells, int(len(x) ** 0.5)))
    centres = nearest._centres(x, n)
    m = -(-x.shape[1] // PART)
    rest = Model(centres, np.zeros((m, 1, PART)), 1, 1).parts(x - centres[(x @ centres.T).argmax(axis=1)])
    words = min(WORDS, len(x))
    books = np.empty((m, words, PART))
    for j in range(m):
        part = rest[:, j]
        book = part[np.linspace(0, len(part) - 1, words).astype(int)].copy()
        for _ in range(rounds):
            own = ((book * book).sum(axis=1) - 2 * part @ book.T).argmin(axis=1)
            count = np.bincount(own, minlength=words)
            sums = np.stack([np.bincount(own, part[:, d], words) for d in range(PART)], axis=1)
            book = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], book)
        books[j] = book
    model = Model(centres, books, nearest._probes(x, centres, k, LEAVES), 1)
    cell, codes = model.code(x)
    ranks = []
    for i in range(min(len(x), nearest.TRIED)):
        near = np.argsort(-(x @ x[i]), kind="stable")
        near = near[near != i][:k]
        score = model.score(x[i : i + 1], codes)[0] + (centres @ x[i])[cell]
        ranks.append((score[:, None] > score[near]).sum(axis=0))
    found = np.sort(np.concatenate(ranks)) if ranks else np.zeros(1, int)
    keep = int(found[int(np.ceil(LEAVES * len(found))) - 1]) + 1 if len(found) else 1
    return Model(centres, books, model.probes, max(4 * k, keep))


@dataclass(frozen=True)
class Stored:
    model: Model
    rows: KeyedTable
    path: str

    def add(self, df: DataFrame, key: str, vector: str) -> int:
        """Indexes rows, or moves those whose key is known; rows without a vector are not indexed. Says the version after it."""
        model, name = self.model, self.rows.key
        rows = df.where(F.col(vector).isNotNull()).select(F.col(key).alias(name), F.col(vector).cast("array<float>").alias("v"))

        def run(batches):
            for batch in batches:
                if len(batch):
                    cell, codes = model.code(nearest._unit(batch.column(1)))
                    packed = pa.array([c.tobytes() for c in codes], pa.binary())
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell.astype(np.int32)), packed, batch.column(1)], names=[name, "cell", "code", "v"])

        kind = self.rows.schema[name].dataType.simpleString()
        return self.rows.upsert(rows.mapInArrow(run, f"{name} {kind}, cell int, code binary, v array<float>"))

    def remove(self, keys: DataFrame) -> int:
        return self.rows.delete(keys)

    def candidates(self, queries: DataFrame, key: str, vector: str, probes: int | None = None, keep: int | None = None, sizes: tuple[int, int] = (nearest.ROWS, nearest.QUERIES)) -> DataFrame:
        """(query, key) of the rows that are compared exactly: the best `keep` by codes in the nearest cells of each query."""
        model, name = self.model, self.rows.key
        probes, keep = min(probes or model.probes, len(model.centres)), keep or model.keep
        asked = nearest._placed(nearest._vectors(queries, key, vector).withColumnRenamed(key, "query"), "query", model.centres, probes)
        rows = self.rows.read("cell", "code").withColumnRenamed(name, "__id")
        kinds = dict(asked.dtypes)["query"], dict(rows.dtypes)["__id"]

        def near(t: pa.Table, q: pa.Table) -> pa.Table:
            ids, found, scores = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
            if len(t) and len(q):
                codes = np.frombuffer(b"".join(t["code"].to_pylist()), np.uint8).reshape(len(t), -1)
                y, centre = nearest._unit(q["v"]), model.centres[t["cell"][0].as_py()]
                for i in range(0, len(y), 128):
                    s = model.score(y[i : i + 128], codes) + (y[i : i + 128] @ centre)[:, None]
                    best = min(keep, s.shape[1])
                    top = np.argpartition(-s, best - 1, axis=1)[:, :best]
                    ids.append(np.repeat(np.arange(i, i + len(s)), best)), found.append(top.ravel()), scores.append(np.take_along_axis(s, top, 1).ravel())
            return pa.table({"query": q["query"].take(pa.array(np.concatenate(ids))), "__id": t["__id"].take(pa.array(np.concatenate(found))), "score": np.concatenate(scores)})

        met = nearest._meeting(rows, asked, sizes, near, f"query {kinds[0]}, __id {kinds[1]}, score double")
        order = Window.partitionBy("query").orderBy(F.desc("score"), "__id")
        return met.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= keep).select("query", F.col("__id").alias(name))

    def search(self, queries: DataFrame, key: str, vector: str, k: int = 10, probes: int | None = None, keep: int | None = None, sizes: tuple[int, int] = (nearest.ROWS, nearest.QUERIES)) -> DataFrame:
        """(query, key, similarity): the k nearest rows of each query among its candidates, rounded to 9 places, the smaller key first on ties.
        With all cells looked at and all rows kept it is exact. Where as many rows are kept as there are, codes would choose nothing: vectors are compared
        where blocks of rows and queries meet, and a query leaves each with its k best only."""
        name, model = self.rows.key, self.model
        if (keep := keep or model.keep) > nearest.ROWS and keep >= self.rows.read("cell").count():
            whole = nearest.Index(self.rows.read("cell", "v"), name, model.centres, model.probes)
            return nearest.search(whole, queries, key, vector, k, probes, sizes)
        pairs = dedup.checkpointed(self.candidates(queries, key, vector, probes, keep, sizes))
        asked = nearest._vectors(queries, key, vector).select(F.col(key).alias("query"), F.col("v").alias("__q"))
        both = pairs.join(self.rows.read("v"), name).join(asked, "query")
        kinds = dict(both.dtypes)

        def exact(batches):
            for batch in batches:
                if len(batch):
                    x, y = (nearest._unit(batch.column(i)) for i in (2, 3))
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.round((x * y).sum(axis=1), 9))], names=["query", name, "similarity"])

        found = both.select("query", name, "v", "__q").mapInArrow(exact, f"query {kinds['query']}, {name} {kinds[name]}, similarity double")
        order = Window.partitionBy("query").orderBy(F.desc("similarity"), name)
        return found.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= k).drop("__n")


def _table(spark: SparkSession, path: str, name: str, kind: str, buckets: int) -> KeyedTable:
    return KeyedTable(spark, f"{path}/rows", f"`{name}` {kind}, cell int, code binary, v array<float>", name, buckets)


def create(df: DataFrame, key: str, vector: str, path: str, k: int = 10, sample: int = nearest.SAMPLE, buckets: int = 16) -> Stored:
    """Fits a model on the rows of the smallest hashes of keys, `sample` at most, stores it, and indexes all rows."""
    spark, rows = df.sparkSession, nearest._vectors(df, key, vector)
    taken = rows.orderBy(F.xxhash64(F.col(key).cast("string")), key).limit(sample).select("v").toArrow()["v"]
    if not len(taken):
        raise ValueError("an index is fitted on rows that have a vector")
    model = fit(nearest._unit(taken), k)
    kind = dict(rows.dtypes)[key]
    facts = json.dumps({"key": key, "kind": kind, "buckets": buckets, "probes": model.probes, "keep": model.keep, "shapes": [model.centres.shape, model.books.shape]})
    saved = [(facts, bytearray(model.centres.astype("<f8").tobytes()), bytearray(model.books.astype("<f8").tobytes()))]
    spark.createDataFrame(saved, "facts string, centres binary, books binary").coalesce(1).write.parquet(f"{path}/model")
    stored = Stored(model, _table(spark, path, key, kind, buckets), path)
    stored.add(df, key, vector)
    stored.rows.compact()
    return stored


def load(spark: SparkSession, path: str) -> Stored:
    r = spark.read.parquet(f"{path}/model").first()
    facts = json.loads(r.facts)
    centres, books = (np.frombuffer(bytes(b), "<f8").reshape(s) for b, s in zip((r.centres, r.books), facts["shapes"], strict=True))
    return Stored(Model(centres, books, facts["probes"], facts["keep"]), _table(spark, path, facts["key"], facts["kind"], facts["buckets"]), path)
