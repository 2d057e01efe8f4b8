"""Exact quantiles within groups, selected by counted buckets."""

import random

import numpy as np
from pyspark.sql import functions as F

from parlance.operators import prosody, ranks


def test_keyed_quantiles_against_numpy(spark):
    """Groups of one row, of ties, of nulls alone, a null key, and one group that holds most rows; keys named like the operator's own columns."""
    r = random.Random(3)
    rows = [("one", 1, 7.5, None), ("ties", 1, 2.0, 1.0), ("ties", 1, 2.0, 1.0), ("none", 2, None, None)]
    rows += [(None, r.randrange(3), r.gauss(0, 1), r.choice([None, r.random()])) for _ in range(200)]
    rows += [("hot", 1, r.choice([-1, 1]) * r.expovariate(1) * 10 ** r.randrange(-3, 6), float(r.randrange(9))) for _ in range(3_000)]
    df = spark.createDataFrame(rows, "c string, k int, x double, y double")
    asked = {"x": [0.0, 0.25, 0.5, 0.99, 1.0], "y": [0.5]}
    names = {(c, q): f"{c}_{q}" for c, qs in asked.items() for q in qs}
    got = {(g["c"], g["k"]): g for g in ranks.quantiles(df, asked, names, ["c", "k"]).collect()}
    groups = {}
    for c, k, x, y in rows:
        groups.setdefault((c, k), []).append((x, y))
    assert set(got) == set(groups) - {("none", 2)}
    for key, own in groups.items():
        for i, c in enumerate("xy"):
            v = [o[i] for o in own if o[i] is not None]
            for q in asked[c]:
                if key in got:
                    assert got[key][names[c, q]] is None if not v else np.isclose(got[key][names[c, q]], np.quantile(v, q), rtol=1e-12)


def test_with_medians_keeps_groups_without_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 4.0), ("b", None), (None, 3.0)], "g string, x double")
    out = ranks.with_medians(df.groupBy("g").agg(F.count("*").alias("n")), df, {"x": "m"}, ["g"])
    assert {(r.g, r.n, r.m) for r in out.collect()} == {("a", 2, 2.5), ("b", 1, None), (None, 1, 3.0)}
    none = df.filter("false")
    assert ranks.with_medians(none.groupBy("g").agg(F.count("*").alias("n")), none, {"x": "m"}, ["g"]).count() == 0
    assert ranks.with_medians(none.agg(F.count("*").alias("n")), none, {"x": "m"}).first().m is None


def test_rollup_has_no_map_of_values(spark):
    df = spark.createDataFrame([], "a string, b string, x double")
    out = prosody.aggregates(df, [["a"], ["a", "b"]], ["x"])
    assert "percentile" not in out._jdf.queryExecution().optimizedPlan().toString() and out.count() == 0
    rows = spark.createDataFrame([("p", "q", 1.0), ("p", None, 4.0)], "a string, b string, x double")
    assert {(r.level, r.a, r.b, r.x_median) for r in prosody.aggregates(rows, [["a"], ["a", "b"]], ["x"]).collect()} == {("a", "p", None, 2.5), ("a+b", "p", "q", 1.0), ("a+b", "p", None, 4.0)}


def test_groups_are_not_broadcast(spark):
    """What is joined to groups has rows by group: gathered on the driver it fills its memory."""
    df = spark.range(20_000).select((F.col("id") % 5000).alias("g"), (F.col("id") % 97).cast("double").alias("x"))
    out = ranks.with_medians(df.groupBy("g").agg(F.count("*").alias("n")), df, {"x": "m"}, ["g"])
    sums = ranks.running(df, ranks.number_bucket(F.col("x")), [F.col("x")], {"s": F.lit(1)}, ["g"])
    for made in (out, sums):
        rows = made.collect()
        assert rows
        assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()
