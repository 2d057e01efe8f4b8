"""Vectors as arrays, computed in double precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column, tiny: float = 1e-12) -> Column:
    """Unit vector; one of a norm up to ``tiny`` stays as it is."""
    n = norm(a)
    whole = F.array(F.struct(a.cast("array<double>").alias("v"), F.when(n <= tiny, F.lit(1.0)).otherwise(n).alias("n")))
    return F.get(F.transform(whole, lambda s: F.transform(s["v"], lambda x: x / s["n"])), F.lit(0))  # the norm once, not for each number


def cosine(a: Column, b: Column, floor: float = 1e-10) -> Column:
    """Cosine with each norm at least ``floor``."""
    return dot(a, b) / (F.greatest(norm(a), F.lit(floor)) * F.greatest(norm(b), F.lit(floor)))


def mean_vectors(df: DataFrame, keys: list[str], vector: str, into: str = "centroid") -> DataFrame:
    """Mean vector and row count of each key; partial sums are made before rows are sent."""
    parts = df.filter(F.col(vector).isNotNull()).select(*keys, F.posexplode(F.col(vector).cast("array<double>")).alias("__i", "__x"))
    means = parts.groupBy(*keys, "__i").agg(F.avg("__x").alias("__m"), F.count("*").alias("__n"))
    return means.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", "__m"))), lambda s: s["__m"]).alias(into), F.max("__n").alias("n_vectors"))
