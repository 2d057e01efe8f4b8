"""Bounded text joins against comparing all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from parlance.operators import textjoin


def texts(seed, n, longest):
    """Words of a Zipf-like vocabulary, so that a few are in most texts."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    return [" ".join(r.choices(words, weights, k=r.randint(0, longest))) for _ in range(n)]


def plain(docs, items):
    out = {}
    sets = lambda rows: {k: set((t or "").split()) for k, t in rows}
    a, b = sets(docs), sets(items)
    for d, x in a.items():
        scored = [(-len(x & y) / min(len(x), len(y)), -len(x & y) / len(x | y), i) for i, y in b.items() if x & y]
        if scored:
            c, j, i = min(scored)
            out[d] = (i, round(-c, 9), round(-j, 9))
    return out


@pytest.fixture
def frames(spark):
    docs = list(enumerate(texts(1, 300, 120))) + [(900, None), (901, ""), (902, "w0"), (903, "nothing known"), (904, "w0 w1 w2")]
    items = list(enumerate(texts(2, 60, 40))) + [(900, None), (901, "w0"), (902, "w0")]
    return docs, items, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("first", [0.0, 0.5, 0.9, 1.0])
def test_best_items_equal_all_pairs(frames, first):
    docs, items, d, i = frames
    got = {r.doc_id: (r.item_id, round(r.containment, 9), round(r.jaccard, 9)) for r in textjoin.best_items(d, i, first=first).collect()}
    assert got == plain(docs, items)


def test_few_pairs_meet(frames):
    """Bounds leave a small share of the pairs that share a token."""
    docs, items, d, i = frames
    a, b = textjoin.token_sets(d, "doc_id", "text"), textjoin.token_sets(i, "item_id", "text")
    index = textjoin.postings(b)
    every = textjoin.met(a, index, F.lit(0.0)).count()
    best = spark_best(a, b, index)
    left = textjoin.met(a.join(best, "id"), index, F.col("sure")).count()
    assert left < every / 3


def spark_best(a, b, index):
    return textjoin.compared(textjoin.met(a, index, F.lit(0.0)), a, b).groupBy("id").agg(F.max("containment").alias("sure"))


def test_empty_tables(frames):
    _, _, d, i = frames
    assert textjoin.best_items(d.limit(0), i).count() == 0 and textjoin.best_items(d, i.limit(0)).count() == 0
