"""Profiles without a task that holds a column, and runs that prepare their segments once."""

import pytest

from parlance.operators import prosody
from parlance.plans import catalogue as C
from parlance.plans import reports


def test_no_task_holds_a_column(spark):
    df = spark.createDataFrame([(x, y) for x, y in zip([3.0, 1.0, None, 2.0, 10.0], [7, 7, 7, None, 9])], "a double, b long")
    out = prosody.described(df, ["a", "b"])
    rows = {r["column"]: r for r in out.collect()}
    assert [rows["a"][k] for k in ("n", "mean", "min", "p25", "p50", "p75", "max")] == pytest.approx([4, 4, 1, 1.75, 2.5, 4.75, 10])
    assert [rows["b"][k] for k in ("n", "p25", "p50", "p75")] == pytest.approx([4, 7, 7, 7.5])
    assert "percentile" not in out._jdf.queryExecution().executedPlan().toString()
    none = prosody.described(df.limit(0), ["a"]).first()
    assert none["n"] == 0 and none["p50"] is None


def test_segments_are_fused_once(spark, monkeypatch):
    calls, fused = [], C._fused
    monkeypatch.setattr(C, "_fused", lambda *a: calls.append(a) or fused(*a))
    assert reports.fusion_run_summary(spark, "/root/testdata/sf0.001").count() == 5
    assert len(calls) == 1
