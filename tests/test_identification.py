"""Identification by bounds against comparing all."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.operators import voiceprint


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def frames(spark, profiles, queries):
    p = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(profiles)], "person_id int, profile array<double>")
    q = spark.createDataFrame([(i, i % 7, [float(c) for c in v]) for i, v in enumerate(queries)], "sample_id int, person_id int, v array<double>")
    return q, p


def brute(profiles, queries):
    s = unit(queries) @ profiles.T
    order = np.lexsort((np.broadcast_to(np.arange(s.shape[1]), s.shape), -np.round(s, 12)), axis=1)
    at = np.arange(len(s))
    return {i: (int(order[i, 0]), s[i, order[i, 0]], s[at[i], order[i, 1]]) for i in at}


def clusters(seed, n, size, dim=32, loose=0.2):
    rng = np.random.default_rng(seed)
    centres = unit(rng.normal(size=(n, dim)))
    return unit(np.repeat(centres, size, 0) + loose * unit(rng.normal(size=(n * size, dim)))), centres, rng


@pytest.mark.parametrize("how", [{"pivots": 64}, {"pivots": 64, "part": 4, "ring": 0.03}, {"pivots": 2, "ring": 0.5}, {"pivots": 5000}])
def test_found_equals_brute_force(spark, how):
    profiles, centres, rng = clusters(3, 25, 30)
    queries = np.concatenate((unit(centres[rng.integers(0, 25, 60)] + 0.3 * unit(rng.normal(size=(60, 32)))), rng.normal(size=(20, 32))))
    q, p = frames(spark, profiles, queries)
    want = brute(profiles, queries)
    rows = voiceprint.identified(q, p, **how).collect()
    assert len(rows) == len(queries)
    for r in rows:
        best, one, two = want[r.sample_id]
        assert r.best == best and r.truth == r.sample_id % 7
        assert abs(r.best_score - one) < 1e-9 and abs(r.second_score - two) < 1e-9 and abs(r.margin - (one - two)) < 1e-9


def test_most_blocks_are_not_read(spark):
    """Of clustered profiles under a third of all pairs are compared."""
    profiles, centres, rng = clusters(5, 60, 50)
    queries = unit(centres[rng.integers(0, 60, 200)] + 0.2 * unit(rng.normal(size=(200, 32))))
    q, p = frames(spark, profiles, queries)
    compared = voiceprint.probes(q, p, pivots=256).agg(F.sum(F.size("__held"))).first()[0]
    assert compared < len(profiles) * len(queries) / 3
    assert compared < 0.1 * len(profiles) * len(queries)


def test_ties_missing_vectors_and_few_profiles(spark):
    q, p = frames(spark, np.array([[0.0, 1.0], [1.0, 0.0], [1.0, 0.0]]), np.array([[2.0, 0.0], [0.0, 3.0]]))
    q = q.unionByName(spark.createDataFrame([(9, 1, None), (10, 1, [0.0, 0.0])], q.schema))
    got = {r.sample_id: (r.best, r.best_score, r.second_score) for r in voiceprint.identified(q, p).collect()}
    assert got == {0: (1, 1.0, 1.0), 1: (0, 1.0, 0.0), 9: (None, None, None), 10: (0, 0.0, 0.0)}
    alone = {r.sample_id: (r.best, r.second_score, r.margin) for r in voiceprint.identified(q, p.limit(1)).collect()}
    assert alone == {0: (0, None, None), 1: (0, None, None), 9: (None, None, None), 10: (0, None, None)}
    nobody = voiceprint.identified(q, p.limit(0))
    assert {(r.sample_id, r.best) for r in nobody.collect()} == {(0, None), (1, None), (9, None), (10, None)}
    assert voiceprint.identified(q.limit(0), p).count() == 0
