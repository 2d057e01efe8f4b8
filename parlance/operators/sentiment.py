"""Aggregates of text sentiment by call, role, speaker and phase."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.labels import call_phase, mean_sentiment_class
from parlance.functions.nulls import share_of
from parlance.operators.ranks import with_medians

LABELS = ("negative", "neutral", "positive")


def _measures() -> list[Column]:
    shares = [share_of(F.col("label") == x).alias(f"pct_{x}") for x in LABELS]
    return [F.count("*").alias("n_segments"), F.avg("value").alias("avg_sentiment"), *shares]


def grouped(df: DataFrame, keys: list[str]) -> DataFrame:
    """Segments, mean value and share of each label for each key; missing keys are groups. A missing label counts in no share."""
    return df.groupBy(*keys).agg(*_measures()).withColumn("sentiment_class", mean_sentiment_class(F.col("avg_sentiment")))


def by_speaker(df: DataFrame, keys: list[str], speaker: str = "speaker", role: str = "role") -> DataFrame:
    """By speaker, with the most frequent role (ties by name)."""
    counts = df.filter(F.col(role).isNotNull()).groupBy(*keys, speaker, role).agg(F.count("*").alias("__n"))
    top = counts.groupBy(*keys, speaker).agg(F.min_by(role, F.struct(-F.col("__n"), role)).alias("dominant_role"))
    base = grouped(df, [*keys, speaker])
    theirs = top.select(*[F.col(k).alias(f"__k_{k}") for k in (*keys, speaker)], "dominant_role")
    on = F.lit(True)
    for k in (*keys, speaker):
        on = on & base[k].eqNullSafe(theirs[f"__k_{k}"])
    return base.join(theirs, on, "left").select(*base.columns, "dominant_role")


def with_phase(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with the start over the call's end (``position``) and its third (``phase``)."""
    last = F.max("end_s").over(Window.partitionBy(*keys))
    return df.withColumn("position", F.try_divide("start_s", last)).withColumn("phase", call_phase(F.col("position")))


def most_negative(df: DataFrame, keys: list[str], n: int = 20, role: str = "CLIENT") -> DataFrame:
    """Calls whose speakers of a role are the most negative in the mean."""
    return grouped(df.filter(F.col("role") == role), keys).orderBy(F.col("avg_sentiment").asc_nulls_last(), *keys).limit(n)


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Rows and percent of each value, the missing one included; the total is summed over the groups."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return counts.withColumn("pct", 100 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))


def long_metrics(row: DataFrame) -> DataFrame:
    """A table of one row as (metric, value)."""
    items = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in row.columns]))
    return row.select(items.alias("x")).select("x.*")


def quality_summary(df: DataFrame, key: str, min_words: int = 2) -> DataFrame:
    """Counts of segments, calls, texts and words as (metric, value)."""
    empty = F.coalesce(F.trim("text"), F.lit("")) == ""
    one = df.agg(
        F.count("*").alias("n_segments"), F.count_distinct(key).alias("n_calls"), F.sum(empty.cast("long")).alias("n_empty"), F.sum((F.col("n_words") >= min_words).cast("long")).alias("n_eligible"),
        F.avg("n_words").alias("mean_words"), F.sum(F.col("role").isNull().cast("long")).alias("n_no_role"),
    )
    return long_metrics(with_medians(one, df, {"n_words": "median_words"}))


def merged_results(base: DataFrame, results: DataFrame, uid: str, newest: Column) -> DataFrame:
    """Base rows with the newest result of their id; ids that a run has done are not asked again by :func:`pending`."""
    last = results.withColumn("__rn", F.row_number().over(Window.partitionBy(uid).orderBy(newest.desc()))).filter("__rn = 1").drop("__rn")
    return base.join(last, uid, "left")


def pending(base: DataFrame, results: DataFrame, uid: str) -> DataFrame:
    """Base rows without a result."""
    return base.join(results.select(uid), uid, "left_anti")
