"""Shared storage, key columns and Arrow plumbing for the corpus operators."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidewatch.session import shared_folder

#: Text bytes that one numpy pass holds; a longer document is a pass of its own.
PASS_BYTES = 1 << 20


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder: lost executors cost nothing that came before."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_table(spark: SparkSession, name: str) -> str:
    """The path of a new table in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def row_sig(text: str = "text") -> Column:
    """Tells rows apart that share a doc_id: with the id, it stands for the row in joins."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def row_key(sig: Column) -> Column:
    """One exact join key for (doc_id, sig), so that a join and a later dedup share one shuffle; null ids are equal."""
    return F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.hex(sig))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings of a column and the offsets between them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if column.null_count:
        column = column.fill_null("")
    _, at, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[off[0] : off[-1]], off - off[0]


def passes(column: pa.Array, most: int = PASS_BYTES):
    """(first row, row after the last, bytes, offsets) of consecutive rows of at most so many bytes, or one row."""
    data, off = utf8(column)
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        j = min(j, n)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def arrow_schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def mapped(df: DataFrame, kernel, schema: str) -> DataFrame:
    """mapInArrow of a kernel that takes a RecordBatch and returns columns (or yields several lists of them)."""
    arrow = arrow_schema(schema)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                for cols in kernel(batch):
                    yield as_batch(cols, arrow)

    return df.mapInArrow(run, schema)


def as_batch(cols, arrow: pa.Schema) -> pa.RecordBatch:
    out = []
    for x, f in zip(cols, arrow, strict=True):
        if isinstance(x, pa.ChunkedArray):
            x = x.combine_chunks()
        if not isinstance(x, pa.Array):
            x = pa.array(x, type=f.type) if not isinstance(x, np.ndarray) else pa.array(x).cast(f.type)
        out.append(x if x.type == f.type else x.cast(f.type))
    return pa.RecordBatch.from_arrays(out, schema=arrow)
