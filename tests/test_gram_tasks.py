"""Texts travel to the tasks that make their grams; grams do not, and a task's share does not grow with the table."""

import random
from collections import Counter
from math import log, sqrt

import pytest
from pyspark.sql import functions as F

from parlance.operators import reports, roles


def exchanges(df):
    """How rows are dealt in the plan that was run."""
    return [line for line in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in line]


def grams(text):
    words = [f" {w} " for w in text.split()]
    return Counter(w[i : i + n] for w in words for n in (3, 4, 5) for i in range(len(w) - n + 1))


def cosine(a, b, texts):
    df = Counter(g for t in texts for g in grams(t))
    w = lambda t: {g: k * (log((1 + len(texts)) / (1 + df[g])) + 1) for g, k in grams(t).items()}
    x, y = w(a), w(b)
    size = lambda v: sqrt(sum(k * k for k in v.values()))
    return sum(k * y[g] for g, k in x.items() if g in y) / (size(x) * size(y))


def some(seed, n):
    r = random.Random(seed)
    return [" ".join(r.choices(["alpha", "beta", "gamma", "delta", "omega", "kappa"], k=6)) for _ in range(n)]


def test_pairs_keep_their_grams(spark):
    a, b = some(1, 20), some(2, 20)
    df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(zip(a, b))] + [(90, None, "alpha"), (91, "", ""), (92, "zz", "yy")], "k long, a string, b string")
    out = reports.text_pair_scores(df, "k", "a", "b")
    got = {r.k: r.cosine for r in out.collect()}
    assert [got[i] for i in range(20)] == pytest.approx([cosine(x, y, [x, y]) for x, y in zip(a, b)])
    assert got[90] == got[91] == got[92] == 0
    assert not any("gram" in line for line in exchanges(out))


def test_roles_keep_their_grams(spark):
    e = spark.createDataFrame([(1, str(i), t, 30, 9.0, 3) for i, t in enumerate(some(3, 2))], "k long, speaker string, evidence_text string, n_words long, seconds double, n_rows long")
    o = spark.createDataFrame([(1, r, t) for r, t in zip(("AGENT", "CLIENT"), some(4, 2))], "k long, role string, role_text string")
    out = roles.role_scores(e, o, "k")
    assert out.count() == 4 and len(out.collect()) == 4
    assert not any("gram" in line for line in exchanges(out))


def test_more_text_more_tasks(spark, monkeypatch):
    df = spark.createDataFrame([(i, "x" * 100) for i in range(50)], "k long, t string")
    monkeypatch.setattr(roles, "TASK_CHARS", 1000)
    assert roles.dealt_by_size(df, ["k"], F.length("t")).rdd.getNumPartitions() == 6
    assert roles.dealt_by_size(df.limit(0), ["k"], F.length("t")).rdd.getNumPartitions() == 1


@pytest.mark.parametrize("stripe", [256, 3])
def test_calls_dealt_in_stripes_score_alike(spark, monkeypatch, stripe):
    """A call of more turns than a task compares gives the scores of the whole call."""
    monkeypatch.setattr(roles, "STRIPE", stripe)
    t, w = some(5, 11), some(6, 7)
    turns = spark.createDataFrame([(1, i, x) for i, x in enumerate(t)] + [(2, 0, "alone")], "k long, turn long, turn_text string")
    windows = spark.createDataFrame([(1, i, x) for i, x in enumerate(w)] + [(3, 0, "alone")], "k long, window long, window_text string")
    out = roles._window_cosines(turns, windows, "k", "turn", "window")
    rows = out.collect()
    got = {(r.turn, r.window): r.cosine for r in rows}
    assert len(rows) == len(got)
    assert got == pytest.approx({(i, j): c for i, x in enumerate(t) for j, y in enumerate(w) if (c := cosine(x, y, t + w))})
    assert not any("gram" in line for line in exchanges(out))
