"""Ranks, running sums and exact quantiles over whole tables without a window that holds them in one task.

Rows are dealt into *buckets*: numbers that grow with the value and depend on it alone. Ranks within a
bucket are taken side by side; what comes before a bucket is summed over one row for each bucket. A
double's bucket is its magnitude to 1 / 4096 of an octave, so values spread over many buckets unless they
all lie within that; a digest's bucket is its first four hex digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_STEP = 4096
_ZERO = 1100 * _STEP  # more than any double's octave


def number_bucket(c: Column) -> Column:
    """Bucket of a number; null, then falling negatives, zero, positives, infinity, NaN."""
    x = c.cast("double")
    size = F.floor(F.log2(F.abs(x)) * _STEP) + _ZERO
    fine = F.when(x == 0, F.lit(0)).when(x > 0, size).otherwise(-size)
    odd = F.when(F.isnan(x), F.lit(4 * _ZERO)).when(x == float("inf"), F.lit(3 * _ZERO)).when(x == float("-inf"), F.lit(-3 * _ZERO))
    return F.coalesce(odd, fine).cast("long")


def digest_bucket(hex_digest: Column) -> Column:
    return F.conv(F.substring(hex_digest, 1, 4), 16, 10).cast("long")


def running(df: DataFrame, bucket: Column, order: list[Column], sums: dict[str, Column | str], keys: list[str] | None = None) -> DataFrame:
    """``df`` with, for each name in ``sums``, the sum over the rows before in the order (``name``) and over all (``name_all``).

    ``order`` must be total within a bucket; sums run within ``keys``. Null keys are groups.
    """
    keys = keys or []
    base = df.withColumn("__rb", bucket).withColumns({f"__rv_{n}": c if isinstance(c, Column) else F.col(c) for n, c in sums.items()})
    per = base.groupBy(*keys, "__rb").agg(*[F.sum(f"__rv_{n}").alias(f"__rs_{n}") for n in sums])
    among = Window.partitionBy(*(keys or [F.lit(0)]))
    up = among.orderBy("__rb").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select(*[F.col(k).alias(f"__rk_{k}") for k in keys], F.col("__rb").alias("__rk"), *[F.coalesce(F.sum(f"__rs_{n}").over(up), F.lit(0)).alias(f"__ro_{n}") for n in sums], *[F.sum(f"__rs_{n}").over(among).alias(f"{n}_all") for n in sums])
    inner = Window.partitionBy(*keys, "__rb").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = base.withColumns({f"__ri_{n}": F.coalesce(F.sum(f"__rv_{n}").over(inner), F.lit(0)) for n in sums})
    on = ranked["__rb"].eqNullSafe(offsets["__rk"])
    for k in keys:
        on = on & ranked[k].eqNullSafe(offsets[f"__rk_{k}"])
    if keys:  # rows by group and bucket, which are not broadcast
        offsets = offsets.hint("merge")
    return ranked.join(offsets, on).select(*df.columns, *[(F.col(f"__ri_{n}") + F.col(f"__ro_{n}")).alias(n) for n in sums], *[f"{n}_all" for n in sums])


def numbered(df: DataFrame, order: list[str], into: str) -> DataFrame:
    """``df`` numbered from 0 in a total order whose first column is a key of many values: the values are counted, rows are not gathered."""
    first = order[0]
    counts = df.groupBy(F.col(first).alias("__nk")).agg(F.count("*").alias("__nc"))
    before = counts.select("__nk", (F.sum("__nc").over(Window.partitionBy(F.lit(0)).orderBy("__nk").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__nc")).alias("__nb"))
    inner = F.row_number().over(Window.partitionBy(first).orderBy(*order))
    joined = df.withColumn("__ni", inner).join(before, F.col(first).eqNullSafe(F.col("__nk")))
    return joined.select(*df.columns, (F.col("__ni") + F.col("__nb") - 1).alias(into))


def by_digest(df: DataFrame, digest: Column, tie: str, into: str, total: str | None = None, keys: list[str] | None = None) -> DataFrame:
    """``df`` ranked from 1 in the order of a digest (then ``tie``), within ``keys``; ``total`` gets the number of rows."""
    marked = df.withColumn("__dg", digest).withColumn("__one", F.lit(1).cast("long"))
    out = running(marked, digest_bucket(F.col("__dg")), [F.col("__dg"), F.col(tie)], {"__nth": "__one"}, keys)
    return out.select(*df.columns, (F.col("__nth") + 1).alias(into), *([F.col("__nth_all").alias(total)] if total else []))


def average_ranks(df: DataFrame, column: str, into: str) -> DataFrame:
    """One row for each value of a column: ``column, into`` (average rank), ``n_rows`` (of the table, nulls left out)."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("__k"))
    out = running(counts, number_bucket(F.col(column)), [F.col(column)], {"__below": "__k"})
    return out.select(column, (F.col("__below") + (F.col("__k") + 1) / 2.0).alias(into), F.col("__below_all").alias("n_rows"))


def _keyed(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``left`` with the columns that ``right`` adds, where the keys are equal or both null. ``right`` has rows by group, which grow with the table: it is sorted and merged, not gathered on the driver to be broadcast."""
    r = right.select(*[F.col(k).alias(f"__j{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys]).hint("merge")
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & left[k].eqNullSafe(r[f"__j{i}"])
    return left.join(r, on, how).drop(*[f"__j{i}" for i in range(len(keys))])


def quantiles(df: DataFrame, asked: dict[str, list[float]], names: dict[tuple[str, float], str], keys: list[str] | None = None) -> DataFrame:
    """One row of exact quantiles, interpolated between neighbours: a column ``names[c, q]`` for each column and share.

    Values are counted first and placed by bucket; only buckets that hold an asked place are ordered. Nulls are left out.
    With ``keys`` it is one row a group (null keys are groups; a group without any value has no row), and a group of any size
    is dealt over its buckets: no task holds its values.
    """
    keys = keys or []
    items = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in asked]))
    own = [F.col(k).alias(f"__q{i}") for i, k in enumerate(keys)]  # keys may be called c, v, k, b or q
    g = [f"__q{i}" for i in range(len(keys))]
    values = df.select(*own, items.alias("__x")).select(*g, "__x.c", "__x.v").filter("v IS NOT NULL")
    among = Window.partitionBy(*g, "c")
    if keys:  # buckets are counted where the rows are
        values = values.withColumn("b", number_bucket(F.col("v")))
        per = values.groupBy(*g, "c", "b").agg(F.count("*").alias("kb"))
    else:
        counts = values.groupBy("c", "v").agg(F.count("*").alias("k")).withColumn("b", number_bucket(F.col("v")))
        per = counts.groupBy("c", "b").agg(F.sum("k").alias("kb"))
    per = per.withColumn("n", F.sum("kb").over(among)).withColumn("before", F.sum("kb").over(among.orderBy("b")) - F.col("kb"))
    shares = F.map_from_arrays(F.array(*map(F.lit, asked)), F.array(*[F.array(*map(F.lit, qs)).cast("array<double>") for qs in asked.values()]))
    per = per.withColumn("at", F.transform(F.element_at(shares, F.col("c")), lambda q: F.struct(q.alias("q"), (q * (F.col("n") - 1)).alias("p"))))
    inside = lambda i, lo, k: (i >= lo) & (i < lo + k)
    held = per.filter(F.exists("at", lambda x: inside(F.floor(x["p"]), F.col("before"), F.col("kb")) | inside(F.ceil(x["p"]), F.col("before"), F.col("kb")))).select(*g, "c", "b", "before", "at")
    if keys:
        met = _keyed(values, held, [*g, "c", "b"]).groupBy(*g, "c", "b", "v").agg(F.count("*").alias("k"), F.first("before").alias("before"), F.first("at").alias("at"))
    else:
        met = counts.join(held, ["c", "b"])
    placed = met.withColumn("lo", F.col("before") + F.sum("k").over(Window.partitionBy(*g, "c", "b").orderBy("v")) - F.col("k"))
    each = placed.select(*g, "c", "v", "lo", "k", F.explode("at").alias("x"))
    pick = lambda i: F.max(F.when(inside(i, F.col("lo"), F.col("k")), F.col("v")))
    found = each.groupBy(*g, "c", F.col("x.q").alias("q")).agg(F.first("x.p").alias("p"), pick(F.floor("x.p")).alias("a"), pick(F.ceil("x.p")).alias("z"))
    value = F.when(F.col("a") == F.col("z"), F.col("a")).otherwise((F.ceil("p") - F.col("p")) * F.col("a") + (F.col("p") - F.floor("p")) * F.col("z"))
    out = found.groupBy(*g).agg(*[F.max(F.when((F.col("c") == c) & (F.col("q") == q), value)).alias(names[c, q]) for c, qs in asked.items() for q in qs])
    return out.withColumnsRenamed({f"__q{i}": k for i, k in enumerate(keys)})


def with_medians(groups: DataFrame, df: DataFrame, medians: dict[str, str], keys: list[str] | None = None) -> DataFrame:
    """``groups`` (one row a group of ``df``) with the exact median of each column under its name in ``medians``; null without values."""
    half = quantiles(df, {c: [0.5] for c in medians}, {(c, 0.5): n for c, n in medians.items()}, keys)
    return _keyed(groups, half, keys, "left") if keys else groups.crossJoin(F.broadcast(half))
