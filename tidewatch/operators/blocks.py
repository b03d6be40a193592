"""Comparing rows with rows in numpy where no task may hold a whole group: rows are dealt to blocks, and blocks meet in pairs."""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.session import opened, qualified, shared_folder


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """An array column as rows of a matrix; vectors of different lengths are an error."""
    lengths = pc.unique(pc.list_value_length(column))
    if len(lengths) > 1:
        raise ValueError("vectors of different lengths can't be compared")
    return pc.list_flatten(column).to_numpy().astype(np.float64).reshape(len(column), -1)


def dealt(rows: DataFrame, group: str, key: str, size: int) -> tuple[DataFrame, int, int]:
    """(rows with __n and __b, most blocks of a group, pairs of blocks): the blocks of a row's group, about `size` rows each, and
    the row's own by a hash of its key. A group of any size is spread; its count alone decides over how many blocks."""
    counts = rows.groupBy(F.col(group).alias("__g")).agg(F.ceil(F.count("*") / size).cast("int").alias("__n"))
    found = counts.agg(F.max("__n"), F.sum(F.col("__n") * (F.col("__n") + 1) / 2)).first()
    placed = rows.join(counts, F.col(group).eqNullSafe(F.col("__g"))).drop("__g")
    return placed.withColumn("__b", F.pmod(F.xxhash64(key), "__n").cast("int")), found[0] or 0, int(found[1] or 0)


def meeting(placed: DataFrame, group: str, pairs: int, apart: bool = False) -> DataFrame:
    """A row for every pair of blocks __i <= __j that its own is in, partitioned by pair, so that a task has few of them.

    apart: leave out a block's meeting with itself where it meets others.
    """
    rows = placed.withColumn("__o", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    if apart:
        rows = rows.where((F.col("__o") != F.col("__b")) | (F.col("__n") == 1))
    rows = rows.select(*[c for c in placed.columns if c != "__n"], F.least("__o", "__b").alias("__i"), F.greatest("__o", "__b").alias("__j"))
    return rows.repartition(max(1, min(pairs, 20_000)), group, "__i", "__j")


def met(placed: DataFrame, kernel, schema: str, *columns: str, apart: bool = False) -> DataFrame:
    """What kernel(table of two blocks, or of one that meets itself) gives for every pair of blocks __i <= __j of a group (grp), as with meeting. The blocks
    (__b of __n) are written to the shared folder once, and a task reads the two of its pair there, so that no row is sent for each of them.

    apart: leave out a block's meeting with itself where it meets others.
    """
    spark = placed.sparkSession
    at = qualified(spark, f"{shared_folder(spark).rstrip('/')}/blocks-{uuid.uuid4().hex}")
    groups = placed.select("grp", "__n").distinct().withColumn("__g", F.monotonically_increasing_id()).checkpoint()
    own = placed.join(groups.select(F.col("grp").alias("__k"), "__g"), F.col("grp").eqNullSafe(F.col("__k"))).select("__g", "__b", *columns)
    own.repartition("__g", "__b").write.partitionBy("__g", "__b").parquet(at)
    last = F.col("__n") - 1
    pairs = groups.withColumn("__i", F.explode(F.sequence(F.lit(0), last))).withColumn("__j", F.explode(F.sequence(F.col("__i"), last)))
    pairs = (pairs.where((F.col("__i") != F.col("__j")) | (F.col("__n") == 1)) if apart else pairs).select("grp", "__g", "__i", "__j")
    def block(fs: pafs.FileSystem, base: str, g: int, b: int) -> pa.Table | None:
        folder = pafs.FileSelector(f"{base}/__g={g}/__b={b}", allow_not_found=True)
        files = [f.path for f in fs.get_file_info(folder) if f.base_name.endswith(".parquet")]
        parts = [pq.ParquetFile(fs.open_input_file(f)).read() for f in files]
        return pa.concat_tables(parts).append_column("__b", pa.repeat(pa.scalar(b, pa.int32()), sum(map(len, parts)))) if parts else None

    def run(batches):
        fs, base = opened(at)
        for batch in batches:
            for n in range(len(batch)):
                grp, (g, i, j) = batch.column(0).slice(n, 1), (batch.column(k)[n].as_py() for k in (1, 2, 3))
                parts = [t for b in {i, j} if (t := block(fs, base, g, b)) is not None]
                if parts:
                    t = pa.concat_tables(parts)
                    for name, value in (("grp", grp[0]), ("__i", pa.scalar(i, pa.int32())), ("__j", pa.scalar(j, pa.int32()))):
                        t = t.append_column(name, pa.repeat(value, len(t)))
                    yield from kernel(t).to_batches()

    return pairs.repartition(max(1, min(pairs.count(), 20_000))).mapInArrow(run, schema)


def facing(left: DataFrame, right: DataFrame, left_key: str, right_key: str, kernel, schema: str, sizes: tuple[int, int] = (65_536, 8_192)) -> DataFrame:
    """What kernel(table of left rows, table of right rows) gives for every pair of a block of one side and a block of the other.

    Each side is sent once for each block of the other, so neither has to fit on a worker.
    """
    counts = left.agg(F.count("*").alias("a")).join(right.agg(F.count("*").alias("b"))).first()  # one row each
    blocks = [max(1, math.ceil(n / size)) for n, size in zip(counts, sizes, strict=True)]

    def spread(df: DataFrame, key: str, own: int, other: int) -> DataFrame:
        rows = df.select(*[F.col(c).alias(c) for c in df.columns])  # both sides may come of one table
        rows = rows.withColumn(f"__{own}", F.pmod(F.xxhash64(key), F.lit(blocks[own])).cast("int"))
        rows = rows.withColumn(f"__{other}", F.explode(F.sequence(F.lit(0), F.lit(blocks[other] - 1))))
        return rows.repartition(min(blocks[0] * blocks[1], 20_000), "__0", "__1")

    a, b = spread(left, left_key, 0, 1), spread(right, right_key, 1, 0)
    return a.groupBy("__0", "__1").cogroup(b.groupBy("__0", "__1")).applyInArrow(kernel, schema)
