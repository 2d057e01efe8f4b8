"""Sound and text of the same segments: coverage, agreement, disagreement."""

from __future__ import annotations

from math import exp, lgamma, log

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions.nulls import truly
from parlance.operators.ranks import average_ranks, quantiles


def modalities(df: DataFrame, audio: list[str], text: list[str]) -> DataFrame:
    """``df`` with ``has_audio`` and ``has_text``: any of the columns is there."""
    some = lambda cs: F.coalesce(*[F.col(c).cast("string") for c in cs]).isNotNull()
    return df.withColumn("has_audio", some(audio)).withColumn("has_text", some(text))


def coverage(df: DataFrame) -> DataFrame:
    """One row: segments with both, one or none of the modalities, and percent of both."""
    a, t = F.col("has_audio"), F.col("has_text")
    n = lambda c: F.sum(c.cast("long"))
    out = df.agg(F.count("*").alias("n"), n(a & t).alias("both"), n(a & ~t).alias("audio_only"), n(~a & t).alias("text_only"), n(~a & ~t).alias("neither"))
    return out.withColumn("pct_both", F.round(100 * F.col("both") / F.col("n"), 1))


def comparable(df: DataFrame) -> DataFrame:
    return df.filter("has_audio AND has_text")


def correlations(df: DataFrame, pairs: list[tuple[str, str]], least: int = 5) -> DataFrame:
    """Pearson and Spearman of column pairs over complete rows, one row each: ``x, y, n, pearson, spearman``.

    Spearman is Pearson of average ranks. Ranks are of values counted once, so the window holds values, not rows.
    """
    out = None
    for x, y in pairs:
        both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("a"), F.col(y).cast("double").alias("b"))
        ranks = {c: average_ranks(both, c, f"r{c}").drop("n_rows") for c in "ab"}
        ranked = both.join(ranks["a"], "a").join(ranks["b"], "b")
        one = ranked.agg(F.count("*").alias("n"), F.corr("a", "b").alias("p"), F.corr("ra", "rb").alias("s"))
        row = one.select(F.lit(x).alias("x"), F.lit(y).alias("y"), "n", F.when(F.col("n") >= least, F.col("p")).alias("pearson"), F.when(F.col("n") >= least, F.col("s")).alias("spearman"))
        out = row if out is None else out.unionByName(row)
    return out


def p_value(r: float, n: int) -> float:
    """Two-sided p of a correlation under no relation, by Student's t with n - 2 degrees (on the driver)."""
    if n < 3 or abs(r) >= 1:
        return 0.0 if n >= 3 else float("nan")
    df = n - 2
    return _beta_inc(df / 2, 0.5, df / (df + r * r * df / (1 - r * r)))


def with_p_values(correlations: DataFrame, measures: tuple[str, ...] = ("pearson", "spearman")) -> DataFrame:
    """Correlations (one row a pair) with ``p_`` of each measure by :func:`p_value`; null where there is none."""

    @F.pandas_udf("double")
    def p(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if x != x or x is None else p_value(float(x), int(k)) for x, k in zip(r, n)], dtype="float64")

    return correlations.withColumns({f"p_{m}": F.when(F.col(m).isNotNull(), p(F.col(m), F.col("n"))) for m in measures})


def _beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_inc(b, a, 1 - x)
    front = exp(a * log(x) + b * log(1 - x) + lgamma(a + b) - lgamma(a) - lgamma(b)) / a
    c, d, f = 1.0, 0.0, 1.0
    for i in range(300):
        m = i // 2
        top = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + top * d or 1e-300)
        c = 1 + top / c or 1e-300
        f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * (f - 1)


def crosstab(df: DataFrame, rows: str, columns: str, values: list[str]) -> DataFrame:
    """Counts of row and column values, missing ones left out, 0 where none."""
    both = df.filter(F.col(rows).isNotNull() & F.col(columns).isNotNull())
    return both.groupBy(rows).pivot(columns, values).agg(F.count(F.lit(1))).na.fill(0)


def disagreement(df: DataFrame, scores: list[str], text: str, high: float = 0.75, text_at: float = 0.0) -> DataFrame:
    """``df`` with ``audio_negative`` (a score at or over its percentile), ``masked_frustration`` and ``contained_negativity``.

    The percentiles are one row, read before the plan goes on.
    """
    ends = quantiles(df, {c: [high] for c in scores}, {(c, high): c for c in scores}).first()
    neg = F.lit(False)
    for c in scores:
        neg = neg | truly(F.col(c) >= F.lit(ends[c]).cast("double"))
    out = df.withColumn("audio_negative", neg)
    fine = truly(F.col(text) >= text_at)
    low = truly(F.col(text) < text_at)
    return out.withColumn("masked_frustration", fine & F.col("audio_negative")).withColumn("contained_negativity", low & ~F.col("audio_negative"))


def fused(df: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Means of the measures by keys, without missing keys, and sizes."""
    there = F.lit(True)
    for k in keys:
        there = there & F.col(k).isNotNull()
    return df.filter(there).groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(F.col(m).cast("double")).alias(f"mean_{m}") for m in measures])


def percentile_rank(df: DataFrame, column: str) -> DataFrame:
    """``df`` with the average-tie rank of a column over the number of rows; null without a value."""
    ranks = average_ranks(df, column, "__r").select(F.col(column).alias("__v"), (F.col("__r") / F.col("n_rows")).alias("pct_rank"))
    return df.join(ranks, df[column] == ranks["__v"], "left").drop("__v")
