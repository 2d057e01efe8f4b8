"""Scans dealt over time bins give what the scan of the whole recording gives."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parlance.operators import intervals

SCHEMA = "audio_id string, seg_id long, speaker string, start_s double, end_s double"
segment = st.tuples(st.sampled_from(["a", "b", None]), st.sampled_from(["x", "x", "x", "y", None]), st.one_of(st.integers(0, 40).map(float), st.sampled_from([None, -3.5, 1e9, float("inf"), float("nan")])), st.one_of(st.integers(0, 45).map(float), st.none()))


def rows_of(df, *cols):
    return sorted((tuple(str(r[c]) for c in cols) for r in df.collect()))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(segment, max_size=40), bin_s=st.sampled_from([0.5, 1.0, 3.0, 7.0, 1000.0]), gap=st.sampled_from([0.0, 0.5, 2.0]))
def test_islands_over_bins(spark, rows, bin_s, gap):
    """Nulls, NaN, infinite times, ties and empty tables included."""
    df = spark.createDataFrame([(a, i, s, b, e) for i, (a, s, b, e) in enumerate(rows)], SCHEMA)
    whole, dealt = (rows_of(intervals.islands(df, max_gap=gap, bin_s=x), "seg_id", "run", "island") for x in (None, bin_s))
    assert whole == dealt


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(segment, max_size=30), bin_s=st.sampled_from([0.5, 3.0, 11.0]))
def test_overlap_regions_over_bins(spark, rows, bin_s):
    df = spark.createDataFrame([(a, i, s, b, e) for i, (a, s, b, e) in enumerate(rows)], SCHEMA)
    whole, dealt = (rows_of(intervals.overlap_regions(df, bin_s=x), "audio_id", "start_s", "end_s") for x in (None, bin_s))
    assert whole == dealt


def test_one_recording_is_many_tasks(spark):
    """A recording of 20,000 segments, all of one speaker in stretches over many bins: the whole result, and no bin holds more than its time's rows."""
    rng = random.Random(7)
    rows, t = [], 0.0
    for i in range(20_000):
        t += rng.choice([0.2, 0.9, 2.0])
        rows.append(("one", i, "x" if i % 5_000 < 4_000 or i % 2 else "y", t, t + rng.choice([0.1, 1.0, 400.0 if i % 997 == 0 else 0.5])))
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    how = {"max_gap": 0.5}
    whole, dealt = (rows_of(intervals.merge_adjacent(df, bin_s=x, **how), "seg_id", "start_s", "end_s", "n_merged", "merged_ids") for x in (None, 60.0))
    assert whole == dealt and 1_000 < len(whole) < 20_000
    assert rows_of(intervals.overlap_regions(df), "start_s", "end_s") == rows_of(intervals.overlap_regions(df, bin_s=60.0), "start_s", "end_s")
    most = df.groupBy(intervals.time_bin(F.col("start_s"), 60.0)).count().agg(F.max("count")).first()[0]
    assert most < 200


@pytest.mark.parametrize("name", ["islands", "overlap_regions"])
def test_no_window_over_a_whole_recording_holds_rows(spark, name):
    """In the plan, windows over the recording alone read states (one row a bin), never segments."""
    df = spark.createDataFrame([], SCHEMA)
    plan = getattr(intervals, name)(df, bin_s=60.0)._jdf.queryExecution().optimizedPlan().toString()
    alone = [line for line in plan.splitlines() if "Window [" in line and "__bin" not in line and "__rb" not in line]
    assert not alone, alone
