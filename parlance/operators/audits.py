"""Data-quality rules of a finished table, and checks before it is published."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Check:
    """A named SQL condition over the aggregates of a group."""

    name: str
    holds: str


def audited(df: DataFrame, keys: list[str], aggregates: list[Column], checks: list[Check]) -> DataFrame:
    """Each group with its aggregates, the names of the checks it fails in order, and ``valid``; a check that is unknown fails."""
    facts = df.groupBy(*keys).agg(*aggregates)
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(F.expr(c.holds), F.lit(False)), F.lit(c.name)) for c in checks]))
    return facts.withColumn("failed_checks", F.array_join(failed, ",")).withColumn("valid", F.size(failed) == 0)


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows as often."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def transition_matrix(df: DataFrame, before: str, after: str, values: list[str]) -> DataFrame:
    """Counts from one label to another and their share of the row."""
    wide = df.groupBy(before).pivot(after, values).agg(F.count(F.lit(1))).na.fill(0)
    total = sum((F.col(v) for v in values), F.lit(0))
    return wide.withColumns({f"share_{v}": F.try_divide(F.col(v), total) for v in values})
