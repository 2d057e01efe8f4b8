"""Every catalogue query against its SQL on the smallest tables."""

import math

import pytest

from parlance.plans import reports
from parlance.plans.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else float(f"{v:.9g}") if isinstance(v, float) else v


def key(row):
    return tuple((v is None, str(v)) for v in row)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=key)
    rel = duck.sql(ORACLE_SQL[name])
    assert sorted(rel.columns) == names
    at = [rel.columns.index(c) for c in names]
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=key)
    assert mine == theirs
    assert mine or not hasattr(reports, name)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
