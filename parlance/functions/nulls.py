"""Null, NaN and tie rules that the operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def known(c: Column) -> Column:
    """NaN as null, since Spark orders NaN above all numbers and finds it equal to itself."""
    return F.when(~F.isnan(c), c)


def truly(c: Column) -> Column:
    """A condition with unknown as false."""
    return F.coalesce(c, F.lit(False))


def changed(a: Column, b: Column) -> Column:
    """Whether two values differ, where a missing one always differs."""
    return F.coalesce(a != b, F.lit(True))


def safe_rate(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or missing."""
    return F.try_divide(a, b)


def zero_sum(c: Column) -> Column:
    """Sum, 0 of nothing."""
    return F.coalesce(F.sum(c), F.lit(0))


def share_of(cond: Column) -> Column:
    """Share of all rows, unknown ones included, that meet a condition."""
    return F.avg(F.when(cond, 1.0).otherwise(0.0))


def safe_float(c: Column, default: float | None = None) -> Column:
    """A text as a number; ``default`` where it is none."""
    return F.coalesce(known(c.try_cast("double")), F.lit(default).cast("double"))


def first_text(c: Column) -> Column:
    """Trimmed text; empty, ``nan``, ``none`` and ``<na>`` as null."""
    t = F.trim(c.cast("string"))
    return F.when(~F.lower(t).isin("", "nan", "none", "<na>"), t)


def truthy(c: Column) -> Column:
    """Tolerant boolean of a text: true, 1, yes or ok in any case."""
    return F.coalesce(F.lower(c.cast("string")).isin("true", "1", "yes", "ok"), F.lit(False))
