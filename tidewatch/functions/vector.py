"""Vector expressions over array<float> columns, summed in double precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GUARD = 1e-9


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Dot over the product of norms, with a guard against zero vectors."""
    return dot(a, b) / (norm(a) * norm(b) + GUARD)


def scaled(a: Column, by: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double") * by)


def unit(a: Column) -> Column:
    """The vector at length one; a zero vector stays."""
    length = norm(a)
    return F.when(length > 0, F.transform(a, lambda x: x.cast("double") / length)).otherwise(F.transform(a, lambda x: x.cast("double")))


def vector_sums(df: DataFrame, key: str, vector: str) -> DataFrame:
    """key, n, sum (array), squares (sum of squared norms): partial sums on the map side, one row a key and position."""
    cells = df.select(key, F.posexplode(vector).alias("pos", "x"))
    cells = cells.groupBy(key, "pos").agg(F.sum(F.col("x").cast("double")).alias("s"), F.sum(F.col("x").cast("double") * F.col("x").cast("double")).alias("q"), F.count("*").alias("n"))
    return cells.groupBy(key).agg(
        F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]).alias("sum"), F.sum("q").alias("squares")
    )


def centroids(df: DataFrame, key: str, vector: str) -> DataFrame:
    """key, n, centroid (unit), cohesion: mean pairwise dot by the closed form, 1 for one member."""
    sums = vector_sums(df, key, vector)
    total = F.aggregate("sum", F.lit(0.0), lambda s, x: s + x * x)
    pairs = (total - F.col("squares")) / (F.col("n") * (F.col("n") - 1))
    return sums.select(key, "n", unit(scaled(F.col("sum"), 1 / F.col("n"))).alias("centroid"), F.when(F.col("n") < 2, 1.0).otherwise(pairs).alias("cohesion"))
