"""Operators 11 to 13 against plain versions, and on odd rows."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.llm import divergence, fill_middle, pivot_index

# --- source divergence ----------------------------------------------------------------------------


def plain_audit(rows, least=3, most=200):
    """Every group gets every kept term."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    count, docs, groups = Counter(), Counter(), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))
        for t in terms:
            count[lang, source, t] += 1
        for t in set(terms):
            docs[lang, t] += 1
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for (lg, t), n in docs.items() if lg == lang and n >= least]
        sources = sorted(s for lg, s in groups if lg == lang)
        share = {}
        for s in [*sources, None]:
            n = {t: sum(count[lang, x, t] for x in sources) if s is None else count[lang, s, t] for t in kept}
            total = sum(n.values()) + len(kept)
            share[s] = {t: 1 + 10**9 * (n[t] + 1) // total for t in kept}
        f = lambda p, q: (p - q) ** 2 // q
        for s in sources:
            pairs = [(o, sum(f(share[s][t], share[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, f(share[s][t], share[None][t])) for t in kept if count[lang, s, t] and share[s][t] > share[None][t]]
            for part, items in (("pair", pairs), ("term", terms)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, i) for i, (item, v) in enumerate(ranked, 1) if part == "pair" or i <= most]
    return sorted(out)


def audit_rows(df, **how):
    return sorted(tuple(r) for r in divergence.audited(df, **how).select("lang", "source", "part", "item", "value", "rank").collect())


def test_audit_against_plain_version(spark):
    rng = np.random.default_rng(3)
    words = [f"W{chr(97 + i % 26)}{chr(97 + i // 26)}é" for i in range(120)]
    rows = []
    for i in range(150):
        zipf = rng.zipf(1.5, 30) % 120
        rows.append((["en", "de", None][i % 3], None if i % 17 == 0 else f"s{i % 7}", " ".join(words[(k + i % 7) % 120] for k in zipf)))
    rows += [("en", "silent", None), ("en", "silent", "123 ..."), ("xx", "only", "a b c a b c"), ("yy", "one", "rare"), ("yy", "two", ""), ("en", "s1", "Ünï©ode ünï ÀB\x00cd日本 abc"), ("en", "s1", "Ünï©ode ünï"), ("en", "s2", "Ünï©ode")]
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    assert audit_rows(df) == plain_audit(rows)
    assert audit_rows(df, most_terms=2, least_docs=1) == plain_audit(rows, 1, 2)


def test_audit_of_odd_rows(spark, odd_docs, no_docs):
    rows = [tuple(r) for r in odd_docs.select("lang", "source", "text").collect()]
    assert audit_rows(odd_docs.repartition(3)) == plain_audit(rows)
    assert audit_rows(no_docs) == []


def test_audit_counts_that_pass_64_bits(spark):
    """Shares of counts over 10^10 are formed in wide decimals."""
    df = spark.createDataFrame([(90_000_000_000, 100_000_000_007)], "c long, t long")
    got = df.select(divergence._share("c", "t").alias("p")).first()["p"]
    assert got == 1 + 10**9 * 90_000_000_001 // 100_000_000_007


def test_slices_of_a_batch_add_up(monkeypatch):
    import pyarrow as pa

    texts = ["One two two", None, "three ONE", "", "two"] * 4
    lang, source = pa.array(["a", None] * 10), pa.array(["x"] * 20)
    total = Counter()
    for size in (1 << 20, 8):
        monkeypatch.setattr(divergence, "SLICE", size)
        got = Counter()
        for b in divergence.counted(lang, source, pa.array(texts)):
            for r in b.to_pylist():
                if r["term"]:
                    got[r["lang"], r["source"], r["term"]] += r["n"]
        total = total or got
        assert got == total


# --- near-duplicate vectors -----------------------------------------------------------------------


def plain_links(ids, vectors, threshold=0.9):
    def fine(v):
        return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)

    unit = [pivot_index.units(np.array([v], float))[0] if fine(v) and i is not None else None for i, v in zip(ids, vectors)]
    n = [0] * len(ids)
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and (vectors[i] == vectors[j] or unit[i] @ unit[j] >= threshold):
                n[i] += 1
                n[j] += 1
                root[find(i)] = find(j)
    least = defaultdict(lambda: math.inf)
    for i, k in enumerate(ids):
        if k is not None:
            least[find(i)] = min(least[find(i)], k)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    return sorted([(k, n[i], None if k is None else int(least[find(i)]), k is None or k == least[find(i)]) for i, k in enumerate(ids)], key=key)


def link_rows(df, **how):
    return sorted([tuple(r) for r in pivot_index.linked(df, **how).select("vec_id", "n_links", "component_id", "kept").collect()], key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def clustered(seed, groups, loose=0.25, dim=32, alone=150):
    rng = np.random.default_rng(seed)
    out = [rng.normal(size=dim) for _ in range(alone)]
    for size in groups:
        centre = rng.normal(size=dim)
        out += [centre + loose * rng.normal(size=dim) for _ in range(size)]
    return [[float(np.float32(x)) for x in v] for v in out]


@pytest.mark.parametrize("sizes", [None, (16, 8)])
def test_links_equal_brute_force(spark, monkeypatch, sizes):
    """Also where long lists and large components are dealt over many units."""
    if sizes:
        monkeypatch.setattr(pivot_index, "LIST", sizes[0])
        monkeypatch.setattr(pivot_index, "UNIT", sizes[1])
    vectors = clustered(5, [60, 2, 2, 3, 9])
    vectors += [vectors[0]] * 5 + [vectors[-1]] * 3
    ids = [7 * i % 997 for i in range(len(vectors))]
    df = spark.createDataFrame([(i, v) for i, v in zip(ids, vectors)], "vec_id long, embedding array<float>")
    assert link_rows(df) == plain_links(ids, vectors)


def test_links_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (3, [1e300, 1e290, 0.0]), (4, [1e-300, 0.0, 0.0]), (5, None), (6, []), (7, [0.0, 0.0, 0.0]), (8, [1.0, None, 0.0]), (9, [nan, 1.0, 0.0]), (10, [inf, 1.0, 0.0]),
        (None, [1.0, 0.0, 0.0]), (11, [1.0, 0.0]), (12, [1.0, 0.1]), (13, [-1.0, 0.0, 0.0]), (14, [1.0, 0.0, 0.0]), (14, [1.0, 0.0, 0.0]), (15, [-0.0, 1.0, 0.0]), (16, [0.0, 1.0, 0.0]), (17, [1.0]), (18, [5.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("node", F.lit("x")).withColumn("u", F.lit(1)).withColumn("root", F.lit(2)).withColumn("kept", F.lit("no"))
    assert link_rows(df) == plain_links([r[0] for r in rows], [r[1] for r in rows])
    assert link_rows(df.limit(0)) == []
    assert link_rows(df.filter("vec_id = 5")) == [(5, 0, 5, True)]
    assert link_rows(df.filter("vec_id = 1")) == [(1, 0, 1, True)]


def test_a_tie_at_the_threshold_is_a_link(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [r[1] for r in link_rows(df, threshold=0.6)] == [1, 2, 1]


def test_recall_at_the_threshold(spark):
    """Pairs that stand alone and are only just linked: the hardest case of the index."""
    rng = np.random.default_rng(11)
    x = pivot_index.units(rng.normal(size=(1500, 64)))
    z = rng.normal(size=x.shape)
    z = pivot_index.units(z - (z * x).sum(1, keepdims=True) * x)
    y = 0.902 * x + math.sqrt(1 - 0.902**2) * z
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(np.concatenate((x, y)))], "vec_id long, embedding array<double>")
    found = pivot_index.linked(df).agg(F.sum("n_links")).first()[0]
    assert found >= 0.96 * 3000


def test_pivots_are_apart_and_descriptions_ordered():
    rng = np.random.default_rng(2)
    x = pivot_index.units(np.concatenate((rng.normal(size=(300, 16)), np.ones((300, 16)) + 0.05 * rng.normal(size=(300, 16)))))
    p = pivot_index.chosen(x, 200, 0.9)
    s = p @ p.T
    assert (s[~np.eye(len(p), dtype=bool)] < 0.9).all()
    near = pivot_index.nearest(x, p, 5)
    d = np.take_along_axis(x @ p.T, near, 1)
    assert (np.diff(d, axis=1) <= 1e-12).all() and np.allclose(d[:, 0], (x @ p.T).max(1))


# --- fill in the middle ---------------------------------------------------------------------------


def plain_middle(key, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{key}".encode()).hexdigest()
    a, b, c, d = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or c % 100 >= 90:
        return n, "plain", None, None, text
    i, j = sorted((a % (n + 1), b % (n + 1)))
    p, m, s = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if d % 100 < 20 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def test_middle_against_plain_version(spark, odd_docs, no_docs, monkeypatch):
    alphabet = ["a", "Bc", "é", "日", "😀", " ", "\n", "\r", "\t", "<", ">", "P", "<P", "S>", "M", "1", "́", "\x00", "'", "\\", "%", "{}"]
    rng = np.random.default_rng(4)
    rows = [(i, "".join(rng.choice(alphabet, rng.integers(0, 40)))) for i in range(600)] + [(1000, "a<M>b"), (1001, "<<P>"), (-5, "minus sign here"), (2**62, "large key here")]
    df = spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd_docs.select("doc_id", "text")).withColumn("key", F.lit("k")).withColumn("output", F.lit(1)).withColumn("form", F.lit(2))
    got = fill_middle.transformed(df)
    want = Counter()
    for r in df.collect():
        n, form, p, m, out = plain_middle("" if r.doc_id is None else r.doc_id, r.text)
        want[r.doc_id, n, form, p, m, sha(out), sha(r.text or ""), out] += 1
    rows = got.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", "output").collect()
    assert Counter(map(tuple, rows)) == want
    assert {r.form for r in rows} == {"plain", "psm", "spm"}
    empty = fill_middle.transformed(no_docs, carry_output=False)
    assert empty.collect() == [] and "output" not in empty.columns


def test_middle_of_slices(spark, monkeypatch):
    """Slices of a batch give what whole batches give."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(50)), "key": [f"1:{i}" for i in range(50)], "text": [None if i % 9 == 0 else "word, " * i for i in range(50)]})
    names = ["doc_id", "form", "output_sha256"]
    out = []
    for size in (1 << 20, 64):
        monkeypatch.setattr(fill_middle, "SLICE", size)
        out.append(sorted(str(r) for b in fill_middle._transform(fill_middle.statement(90, 20), names)(iter([batch])) for r in b.to_pylist()))
    assert out[0] == out[1] and len(out[0]) == 50


def test_parameters_of_the_forms(spark):
    df = spark.createDataFrame([(i, f"some words of text {i}") for i in range(200)], "doc_id long, text string")
    assert {r.form for r in fill_middle.transformed(df, plain_from=0).collect()} == {"plain"}
    assert {r.form for r in fill_middle.transformed(df, plain_from=100, spm_below=100).collect()} == {"spm"}
