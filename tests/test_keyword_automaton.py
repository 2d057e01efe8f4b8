"""Keywords by one automaton against looking for each keyword."""

import random

from pyspark.sql import functions as F

from parlance.operators import keywords

LEXICON = {"one": ["Ab", "abc", "b", "ñandú", "no va", "...", ""], "two": ["abc", "c a", "zz"], "none": [], "big": [f"{a}{b}" for a in "abcdefghij" for b in "abcdefghij"]}


def texts(n=400):
    r = random.Random(9)
    return [None, "", "  ", "Ñandu NO   VA!", "xabcx", "ab", "a\u0301b c"] + ["".join(r.choice("abc dñú,.Z") for _ in range(r.randint(0, 30))) for _ in range(n)]


def spot(df, **how):
    out = keywords.spotted(df, LEXICON, **how)
    names = [c for c in out.columns if c not in df.columns]
    return sorted(out.select("i", *sorted(names)).collect(), key=lambda r: r.i), names


def test_automaton_equals_each_keyword(spark):
    df = spark.createDataFrame(list(enumerate(texts())), "i int, text string").withColumn("themes", F.lit(1))
    many, names = spot(df)
    few, same = spot(df, few=10_000)
    assert many == few and set(names) == set(same)


def test_whole_words_and_overlaps(spark):
    df = spark.createDataFrame([(0, "ab abc c a, no va. Ñandú"), (1, "xabc nova cab"), (2, "b"), (3, "zz zz zz")], "i int, text string")
    rows, _ = spot(df, bounded=True)
    assert [r.kw_one_matched for r in rows] == [["ab", "abc", "nandu", "no va"], [], ["b"], []]
    assert [r.kw_two_matched for r in rows] == [["abc", "c a"], [], [], ["zz"]]
    assert [r.kw_none_count for r in rows] == [0, 0, 0, 0]


def test_empty_lexicon_and_table(spark):
    df = spark.createDataFrame([(0, "ab")], "i int, text string")
    nothing = {"a": [], "b": ["?!"]}
    assert [(r.n_critical_themes, r.total_matches) for r in keywords.spotted(df, nothing, bounded=True).collect()] == [(0, 0)]
    assert keywords.spotted(df.limit(0), LEXICON, bounded=True).count() == 0
