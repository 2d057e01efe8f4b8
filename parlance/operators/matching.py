"""Keyed joins with fallbacks, keep-first selection and key-set checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def resolve_column(df: DataFrame, candidates: list[str], required: bool = False) -> str | None:
    """The first of the candidates that ``df`` has."""
    found = next((c for c in candidates if c in df.columns), None)
    if required and found is None:
        raise KeyError(f"none of {candidates} is there")
    return found


def keep_first(df: DataFrame, keys: list[str], *order: Column) -> tuple[DataFrame, DataFrame]:
    """(first row of each key in the order, the others)."""
    ranked = df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter("__rn = 1").drop("__rn"), ranked.filter("__rn > 1").drop("__rn")


def cascade_match(left: DataFrame, right: DataFrame, left_id: str, exact: list[tuple[str, str]], loose: tuple[str, str], size: tuple[str, str], tie: str) -> DataFrame:
    """For each left row the best right row: by all exact keys, by a loose key that is unique on the right,
    or among several of that key the nearest in size.

    Gives left columns, ``tie`` of the match, ``method`` and ``size_diff``; unmatched rows stay with
    ``method`` none. Right columns must be named unlike left ones.
    """
    lk, rk = loose
    counted = right.withColumn("__n", F.count("*").over(Window.partitionBy(rk)))
    same = F.lit(True)
    for a, b in exact:
        same = same & F.coalesce(F.col(a) == F.col(b), F.lit(False))
    diff = F.abs(F.col(size[0]) - F.col(size[1]))
    method = F.when(same, 1).when(F.col("__n") == 1, 2).otherwise(3)
    pairs = left.join(counted, F.col(lk) == F.col(rk), "left").withColumn("__m", F.when(F.col(rk).isNotNull(), method)).withColumn("size_diff", diff)
    first, _ = keep_first(pairs, [left_id], F.col("__m").asc_nulls_last(), F.col("size_diff").asc_nulls_last(), F.col(tie))
    names = F.when(F.col("__m") == 1, "exact").when(F.col("__m") == 2, "unique").when(F.col("__m") == 3, "nearest").otherwise("none")
    return first.withColumn("method", names).select(*left.columns, tie, "method", F.when(F.col("method") != "none", F.col("size_diff")).alias("size_diff"))


def priority_lookup(left: DataFrame, right: DataFrame, left_id: str, variants: Column, right_key: str, carry: list[str]) -> DataFrame:
    """Each left row with ``carry`` of the right row under the first of its variant keys that is there."""
    keys = left.select(left_id, F.posexplode(variants).alias("priority", "__key"))
    hits = keys.join(right.select(F.col(right_key).alias("__key"), *carry), "__key")
    first = hits.groupBy(left_id).agg(F.min_by(F.struct("priority", "__key", *carry), F.struct("priority", "__key", *carry)).alias("x"))
    return left.join(first, left_id, "left").select(*left.columns, F.col("x.priority").alias("priority"), F.col("x.__key").alias("matched_key"), *[F.col(f"x.{c}").alias(c) for c in carry])


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join in which a missing key meets a missing key; the right side's keys are dropped."""
    r = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    return left.join(r, on, how).drop(*[f"__r_{k}" for k in keys])


def time_key_join(left: DataFrame, right: DataFrame, keys: list[str], times: tuple[str, ...] = ("start_s", "end_s"), digits: int = 3) -> DataFrame:
    """Left join on keys and times rounded half to even; of several right rows of a key the first by its columns."""
    l2, r2 = left, right
    names = [f"__k_{t}" for t in times]
    for t, n in zip(times, names):
        l2, r2 = l2.withColumn(n, F.bround(t, digits)), r2.withColumn(n, F.bround(t, digits))
    rest = sorted(c for c in right.columns if c not in (*keys, *times))
    r2, _ = keep_first(r2.select(*keys, *names, *rest), [*keys, *names], *[F.col(c).asc_nulls_last() for c in rest])
    return null_safe_join(l2, r2, [*keys, *names]).drop(*names)


def duplicate_summary(df: DataFrame, key: str, name: str, most: int = 10) -> DataFrame:
    """Keys with more than one name: how many, and the first names of the sorted set."""
    names = F.array_join(F.slice(F.array_sort(F.collect_set(F.col(name).cast("string"))), 1, most), "|")
    return df.groupBy(key).agg(F.count_distinct(name).alias("n_names"), names.alias("examples")).filter("n_names > 1")


def key_sets(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """One row: keys on either side only and on both, and whether the sets are equal."""
    a = left.select(F.col(left_key).alias("k")).distinct().withColumn("l", F.lit(1))
    b = right.select(F.col(right_key).alias("k")).distinct().withColumn("r", F.lit(1))
    both = a.join(b, "k", "full")
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    out = both.agg(n(F.col("r").isNull()).alias("only_left"), n(F.col("l").isNull()).alias("only_right"), n(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("common"))
    return out.withColumn("equal_sets", (F.col("only_left") == 0) & (F.col("only_right") == 0))


def rows_of_repeated(df: DataFrame, key: str, least: int = 2) -> DataFrame:
    """Rows whose key is there at least so often."""
    often = df.groupBy(key).count().filter(F.col("count") >= least).select(key)
    return df.join(often, key, "left_semi")
