"""Corpus operators on odd rows and against plain versions."""

import math
import random
import zlib

import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

from parlance.llm import ann, components, langid, license_scan, ngram_join, packing, pii, piece_lattice, quality, queries, repeats, url_filter

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# --- 1 ---


def test_license_scan_matches_sql(spark, duck, docs):
    got = license_scan.scan(docs).drop("hits")
    rel = duck.sql(license_scan.oracle_sql())
    assert sorted(map(str, (tuple(r[c] for c in rel.columns) for r in got.collect()))) == sorted(map(str, rel.fetchall()))


def test_license_scan_odd_rows(odd_docs, no_docs):
    rows = license_scan.scan(odd_docs).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 12 and by[1].base_labels == "cc-by" and (by[1].first_word, by[1].n_words) == (4, 7)
    assert by[None].labels == "reserved" and by[2].n_words == by[3].n_words == by[7].n_words == 0 and by[2].labels == "" and by[2].first_word is None
    assert license_scan.scan(no_docs).count() == 0


def test_license_scan_finds_by_containment(spark):
    wrapped = "\n".join(license_scan.TEMPLATES[5].text.split(" the ")).replace("software", "Software", 3)  # the full text over many lines, without its articles
    scattered = " ".join(f"w{i}" if i % 40 else ["licensed", "under", "the", "mit", "license"][i // 40 % 5] for i in range(300))
    rows = [(1, "x\nThis is released, today, under the MIT license!\ny"), (2, "cc by cc by"), (3, "Licensed under the Apache License, Version 2.0."), (4, "license under apache")]
    rows += [(5, "before " * 70 + wrapped + " after" * 70), (6, scattered), (7, "Licensed under\nthe MIT\nlicense"), (8, "licensed under the bsd license"), (9, "Licenced under the Apache License, Version 2.0")]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].labels == "mit" and got[1].score == 1.0 and got[3].labels == "apache-2.0" and got[4].labels == ""
    assert (got[2].n_base, got[2].first_word, got[2].last_word) == (2, 0, 2)
    assert got[5].labels == "mit" and min(h.share for h in got[5].hits) < 1 and got[6].labels == got[8].labels == "" and got[7].labels == "mit" and got[9].labels == "apache-2.0"


def test_license_scan_filters_each_drop_some(spark):
    """Length, prefix and positional filter: each passes what the count passes, and drops some that the others let through."""
    t = license_scan.Template("x", "f g h i j k l m n o")
    rank = {w: i for i, w in enumerate("abcdefghijklmnopqrst")}
    blocks = ["fghijklmno", "fghijklm", "fghijkl", "hijklmno", "ijklmnop", "ghijklmnpqr", "fklpqrst", "abcdepqrst", "abcdehpq", "abcdefgh", "hijklmnop", "abcdehijklmno"]
    df = spark.createDataFrame([(b, sorted(rank[c] for c in b)) for b in blocks], "b string, own array<int>")
    one = F.get(license_scan.template_rows((t,), rank, 0.8), F.lit(0))
    got = df.select("b", *[f.alias(n) for f, n in zip(license_scan.filtered(F.col("own"), one), ("length", "prefix", "place", "count"))]).collect()
    for r in got:
        assert r["count"] == (len(set(r.b) & set("fghijklmno")) >= 8)
        assert not r["count"] or (r.length and r.prefix and r.place)
    assert [r for r in got if not r.length] and [r for r in got if r.length and not r.prefix] and [r for r in got if r.length and r.prefix and not r.place]


def test_license_scan_lowers_ascii_only(spark):
    got = license_scan.scan(spark.createDataFrame([(1, "CC BY, \u212aind"), (2, "ALL RIGHTS RESERVED")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.n_words for r in got] == [3, 3] and [r.base_labels for r in got] == ["cc-by", "reserved"]


# --- 2 ---


def test_url_rules(spark):
    urls = ["http://A.Example.NET/en/x?q", "https://example.com/de/", "http://x.org/fr/a#b", "http://net/", "http://net", "ftp://notexample.com/de/", None, "no scheme/net/", "http://h.net?x/", "http://example.net/EN/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in url_filter.judge(df).collect()}
    assert [got[i].rule for i in range(10)] == ["example.net/en/", "example.com/de/", "org/fr/", "net/", None, None, None, None, None, "net/"]
    assert (got[0].host, got[0].path, got[0].verdict) == ("a.example.net", "/en/x", "allow") and got[6].host == got[7].path == ""
    assert url_filter.judge(df.limit(0)).count() == 0


def test_url_model_is_a_distribution():
    counts = np.zeros(41**4, np.int64)
    counts[np.random.default_rng(0).integers(0, 41**4, 5000)] = 3
    p = np.exp(url_filter.log_probabilities(counts)).reshape(-1, 41).sum(1)
    assert np.allclose(p, 1)


def test_url_model_learns(spark):
    rows = [(i, f"http://{'casino' if i % 2 else 'school'}{i}.{'net' if i % 2 else 'org'}/{'x' if i % 2 else 'fr'}/{i}") for i in range(400)]
    rows += [(1000 + i, f"http://{'casino' if i % 2 else 'school'}{i}.info/a") for i in range(20)]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).filter("rule IS NULL").collect()
    assert all((r.verdict == "block") == (r.page_id % 2 == 1) for r in got)


def test_url_filter_against_plain_version(spark):
    """Scores, rules and verdicts of the whole bundled table; the cut parts the rows set aside as well as any cut can."""
    table = spark.read.parquet(f"{SF}/pages.parquet")
    got = url_filter.judge(table).orderBy("page_id").collect()
    urls = {r.page_id: r.url or "" for r in table.collect()}
    want, aside = plain.url_verdicts([urls[r.page_id] for r in got], url_filter.RULES)
    cut = got[0].cut
    for r, (host, path, rule, verdict, score) in zip(got, want):
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.score == pytest.approx(score, abs=1e-4)
        assert r.verdict == (verdict or ("allow" if r.score >= cut else "block"))
    sides = {s: sorted(x for x, side in aside if side == s) for s in (True, False)}
    if all(sides.values()):
        gain = lambda c: sum(x < c for x in sides[False]) / len(sides[False]) - sum(x < c for x in sides[True]) / len(sides[True])
        assert gain(cut) >= max(gain(c) for c, _ in aside) - 0.02


def test_url_filter_odd_rows(spark):
    """Repeats, ties, a URL of a million characters, columns named like those inside, nothing to learn from, an empty table."""
    long = "http://a.info/" + "x" * 1_000_000
    rows = [(1, "http://a.net/x"), (1, "http://a.net/x"), (2, None), (None, "http://b.org/fr/1"), (3, long), (4, ""), (5, "http://ñandú.example.net/en/é")]
    df = spark.createDataFrame(rows, "page_id long, url string")
    for c in ("host", "path", "rule", "verdict", "score", "cut", "allowed", "code", "n", "ruled", "bin", "count"):
        df = df.withColumn(c, F.lit(c))
    got = url_filter.judge(df).collect()
    assert len(got) == 7 and len({str(r) for r in got if r.page_id == 1}) == 1
    by = {r.page_id: r for r in got}
    assert by[2].host == by[4].host == "" and by[3].path == "/" + "x" * 1_000_000 and by[5].rule == "example.net/en/"
    assert by[None].rule == "org/fr/" and url_filter.judge(df.limit(0)).count() == 0
    one = url_filter.judge(df.filter("page_id = 3")).first()
    assert (one.score, one.cut, one.verdict) == (0.0, 0.0, "allow")


# --- 3 ---


@pytest.fixture(scope="module")
def vocabulary():
    return piece_lattice.Pieces(queries.tokenizer_file("piece_bpe_32k.model"))


def segmentations(v, t):
    known = {x.decode(): i for i, x in enumerate(v.text) if np.isfinite(v.weight[i])}
    s = " " + t

    def go(i):
        if i == len(s):
            yield ()
            return
        if s[i] not in known:
            yield from (tuple(int(x) for x in v.byte_id[list(s[i].encode())]) + r for r in go(i + 1))
        for j in range(i + 1, min(len(s), i + 16) + 1):
            if s[i:j] in known:
                yield from ((known[s[i:j]],) + r for r in go(j))

    return list(go(0))


def test_sampler_draws_without_replacement(vocabulary):
    t, n = "at on\n日", 6000
    all_ = segmentations(vocabulary, t)
    w = np.array([sum(vocabulary.weight[i] for i in x if np.isfinite(vocabulary.weight[i])) for x in all_])
    p = np.exp(w - w.max())
    p /= p.sum()
    got = piece_lattice.Batch(vocabulary, [t] * n, np.arange(n, dtype=np.uint64) * np.uint64(7919)).sample(2)
    at = {x: i for i, x in enumerate(all_)}
    one, two, weight = (np.zeros(len(all_)) for _ in range(3))
    for r in range(n):
        ids = [tuple(g["ids"][g["edges"][r] : g["edges"][r + 1]].tolist()) for g in got]
        assert ids[0] != ids[1]
        one[at[ids[0]]] += 1 / n
        two[at[ids[1]]] += 1 / n
        for g, x in zip(got, ids):
            weight[at[x]] += 1 / g["inclusion"][r] / n
            assert g["log_p"][r] == pytest.approx(math.log(p[at[x]]), abs=1e-4)
    second = np.array([sum(p[i] * p[j] / (1 - p[i]) for i in range(len(p)) if i != j) for j in range(len(p))])
    assert np.abs(one - p).max() < 0.03 and np.abs(two - second).max() < 0.03
    assert abs((weight * p).sum() - 1) < 0.1  # the inclusion scores make the estimate of 1 unbiased


def test_sampler_cut_widens_with_draws():
    assert piece_lattice.far(1) == piece_lattice.FAR and piece_lattice.far(1000) == pytest.approx(piece_lattice.FAR + math.log(1000))


def test_sampler_cuts_long_words(vocabulary, monkeypatch):
    """Cut words have the same log-probabilities of their segmentations as whole ones, and decode to the text."""
    r = random.Random(8)
    text = "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(3000))
    keys = np.arange(4, dtype=np.uint64)
    one = piece_lattice.Batch(vocabulary, [text] * 4, keys)
    assert one.lattices.size.max() < 600 < len(text)
    monkeypatch.setattr(piece_lattice, "LONG", 10**9)
    two = piece_lattice.Batch(vocabulary, [text] * 4, keys)
    assert two.lattices.size.max() > 2000
    whole = lambda b: sum(float(b.lattices.mass[b.lattices.off[b.lattices.size[w]] + w]) for w, row in zip(b.word.tolist(), b.word_row.tolist()) if w >= 0 and row == 0)
    assert whole(one) == pytest.approx(whole(two), rel=1e-4)
    for b in (one, two):
        got = b.sample(2)[0]
        assert piece_lattice.decode_ids(vocabulary, got["ids"][got["edges"][0] : got["edges"][1]].astype("<u4").tobytes()) == text


def test_sampler_rows(odd_docs, no_docs):
    model = queries.tokenizer_file("piece_bpe_32k.model")
    out = piece_lattice.decode(piece_lattice.encode(odd_docs, model, k=3), model)
    rows = out.collect()
    assert all(r.decoded == r.text for r in rows)
    count = {}
    for r in rows:
        count[r.doc_id] = count.get(r.doc_id, 0) + 1
    assert count[2] == count[3] == 1 and count[1] == 3 and count[6] == 6
    assert len({(r.draw, r.ids) for r in rows if r.doc_id == 6}) == 3
    assert piece_lattice.encode(no_docs, model).count() == 0


# --- 4 ---


def test_quality_counts(spark, docs, odd_docs, no_docs):
    for df in (docs.select("doc_id", "text"), odd_docs):
        texts = {(r.doc_id, r.text) for r in df.collect()}
        got = quality.judged(df).collect()
        assert len(got) == df.count()
        for r in got:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain.quality(r.text)
            assert not (r.base_failed and r.kept) and (r.doc_id, r.text) in texts
    assert quality.judged(no_docs).count() == 0
    assert quality.keep_good(odd_docs).columns == odd_docs.columns


def test_quality_keeps_clean_and_drops_junk(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choice("aeioustnrl") for _ in range(r.randrange(2, 9)))
    clean = [(i, " ".join(word() for _ in range(120)) + ".") for i in range(150)]
    junk = [(1000 + i, " ".join(word() + r.choice(["###", "$$$", "|"]) for _ in range(120))) for i in range(15)]
    got = {x.doc_id: x.kept for x in quality.judged(spark.createDataFrame(clean + junk, "doc_id long, text string")).collect()}
    assert all(got[i] for i, _ in clean) and not any(got[i] for i, _ in junk)


def test_quality_letters_with_marks(spark):
    """Vowel signs and tones are letters: the rule votes good on Devanagari, Thai and vowelled Arabic."""
    texts = ["कि यह हिन्दी का एक वाक्य है " * 12, "นี่คือประโยคภาษาไทย ที่มีวรรณยุกต์ " * 12, "هٰذِهِ جُمْلَةٌ عَرَبِيَّةٌ مُشَكَّلَةٌ " * 12]
    got = quality.features(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "text").collect()
    assert all(100 * r["__q_n_letters"] >= 93 * r["__q_word_chars"] for r in got)


def test_posteriors_follow_votes():
    post = quality.expectation_maximisation({"ggg": 900, "bbg": 60, "bb-": 30, "g--": 10})
    assert post["ggg"] > 0.9 > 0.5 > post["bbg"] and quality.expectation_maximisation({}) == {}


def test_posteriors_against_plain_version():
    """Estimation by single documents in place of pattern counts, with the same start and smoothing."""
    r = random.Random(4)
    docs_ = ["".join(r.choice("ggggb-") if r.random() < 0.8 else r.choice("bb-") for _ in range(4)) for _ in range(300)]
    from collections import Counter

    got = quality.expectation_maximisation(dict(Counter(docs_)), rounds=30)
    good, bad = ([dict(x) for _ in range(4)] for x in (quality._GOOD, quality._BAD))
    share = 0.8
    for k in range(30):
        post = []
        for d in docs_:
            a, b = share, 1 - share
            for i, v in enumerate(d):
                a *= good[i][v]
                b *= bad[i][v]
            post.append(a / (a + b))
        if k == 29:
            break
        share = (sum(post) + 8) / (len(docs_) + 10)
        for i in range(4):
            for v in "gb-":
                mine = [q for d, q in zip(docs_, post) if d[i] == v]
                good[i][v] = (sum(mine) + 4 * quality._GOOD[v]) / (sum(post) + 4)
                bad[i][v] = (sum(1 - q for q in mine) + 4 * quality._BAD[v]) / (len(docs_) - sum(post) + 4)
    assert all(got[d] == pytest.approx(q, abs=1e-6) for d, q in zip(docs_, post))


def test_quality_verdicts_follow_posteriors(docs):
    """kept is the posterior's verdict of the document's own votes, but for the base rules."""
    voted = quality.features(docs.select("doc_id", "text"), "text").withColumn("votes", F.concat(*quality.votes()))
    votes = {r.doc_id: r.votes for r in voted.select("doc_id", "votes").collect()}
    rows = quality.judged(docs.select("doc_id", "text"), carry=["doc_id"]).collect()
    from collections import Counter

    post = quality.expectation_maximisation(dict(Counter(votes[r.doc_id] for r in rows if not r.base_failed)))
    for r in rows:
        assert r.kept == (not r.base_failed and post[votes[r.doc_id]] >= 0.5)


def test_scratch_needs_a_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from parlance.llm import scratch

    context = SimpleNamespace(master="spark://host:7077", applicationId="x", getConf=lambda: SimpleNamespace(get=lambda k: None))
    with pytest.raises(RuntimeError):
        scratch.shared_root(SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: None), sparkContext=context))
    before = scratch.written()
    with scratch.working(spark):
        assert scratch.materialise(spark.range(3), "test").count() == 3 and len(scratch.written()) == len(before) + 1
    assert scratch.written() == before


# --- 5 ---


def test_language_codes_are_normalised(spark):
    trees = langid.learn(spark.createDataFrame([("abracadabra banana", "x"), ("xyzzy plugh", "y")], "text string, lang string"), nodes=5000)
    p = np.exp2(-trees.bits)
    assert np.allclose(p[:, :-1].sum(1) + (256 - trees.size + 1) * p[:, -1], 1, atol=1e-4)


def plain_bits(texts, order, t):
    """Code length of bytes t by escape method C with exclusion, all contexts kept."""
    counts = {}
    for x in texts:
        x = b"\0" * order + x
        for i in range(order, len(x)):
            for k in range(order + 1):
                counts.setdefault(x[i - k : i], {}).setdefault(x[i], 0)
                counts[x[i - k : i]][x[i]] += 1
    bits, t = 0.0, b"\0" * order + t
    for i in range(order, len(t)):
        out, found = set(), False
        for k in range(order, -1, -1):
            own = {s: n for s, n in counts.get(t[i - k : i], {}).items() if s not in out}
            if not own:
                continue
            total = sum(own.values()) + len(own)
            if t[i] in own:
                bits -= math.log2(own[t[i]] / total)
                found = True
                break
            bits -= math.log2(len(own) / total)
            out |= set(own)
        if not found:
            bits += math.log2(256 - len(out))
    return bits


def test_language_code_lengths_are_exact(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(langid, "LEAST", 1)
    x, y = ["the cat sat on the mat", "that hat"], ["le chat est sur la table", "une chatte"]
    trees = langid.learn(spark.createDataFrame([(t, "x") for t in x] + [(t, "y") for t in y], "text string, lang string"), nodes=100_000)
    asked = ["the chat", "zebra", "", "lé"]
    got = trees.lengths(pa.array(asked))
    for row, t in zip(got, asked):
        assert row[0] == pytest.approx(plain_bits([s.encode() for s in x], 3, t.encode()), abs=1e-3)
        assert row[1] == pytest.approx(plain_bits([s.encode() for s in y], 3, t.encode()), abs=1e-3)


def test_language_accuracy_and_odd_rows(spark, odd_docs, no_docs):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(big).join(big.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    assert {r.doc_id for r in got.collect()} == {r.doc_id for r in big.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    odd = {r.doc_id: r for r in langid.identify(odd_docs).collect()}
    assert odd[2].lang_pred == odd[3].lang_pred == odd[7].lang_pred == "und" and odd[None].held_out is False
    assert langid.identify(no_docs).count() == 0
    none = langid.identify(odd_docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in none.collect()} == {"und"}


def test_language_every_label_is_learned(spark):
    """More labels than a table holds, or than the 200 that were the bound; each has words of its own."""
    many = [(f"l{k:03d}", " ".join([chr(0x4E00 + 3 * k) + chr(0x4E01 + 3 * k)] * 12)) for k in range(203)]
    rows = [(4 * k + j, text, name) for k, (name, text) in enumerate(many) for j in range(4)]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(2)).collect()
    true = {i: name for i, _, name in rows}
    learned = {true[r.doc_id] for r in got if not r.held_out}
    assert len(learned) > 200 and all(r.lang_pred == true[r.doc_id] for r in got if true[r.doc_id] in learned)


def test_language_contexts_do_not_depend_on_others(spark):
    small, large = [("abcabcabd" * 4, "x")], [("qrstuvwqrstuvx" * 50, "y")]
    one, two = (langid.learn(spark.createDataFrame(rows, "text string, lang string"), nodes=8) for rows in (small, small + large))
    import pyarrow as pa

    asked = pa.array(["abcabd"])
    assert one.lengths(asked)[0, 0] >= two.lengths(asked)[0, 0] - 1e-3


# --- 6 ---


def test_pseudonyms_against_plain(spark):
    rows = [("1234567890123456", "x"), ("00", "x"), ("123456789", "y"), ("7" * 36, "z")]
    df = spark.createDataFrame(rows, "d string, k string")
    for kind in "xyz":
        for r in df.filter(F.col("k") == kind).select("d", pii.permuted_digits("key", kind, F.col("d")).alias("p")).collect():
            assert r.p == plain.permuted("key", kind, r.d)


def test_feistel_is_a_permutation(spark):
    n = spark.range(189 * 773 // 27)  # 5411 values of Z_7 x Z_773
    out = n.select(pii.feistel("k", F.lit("t"), F.floor(F.col("id") / 773), F.col("id") % 773, F.lit(7).cast("long"), F.lit(773).cast("long")).alias("x"))
    assert out.distinct().count() == 7 * 773
    assert out.filter("x.l BETWEEN 0 AND 6 AND x.r BETWEEN 0 AND 772").count() == 7 * 773


def test_pseudonyms_keep_format_and_link(spark):
    a = "mail ana.b@host.example.com, card 4111-1111-1111-1111 or 4111111111111111; ip 10.20.30.40; born 29/02/2020 (2020-02-29), call +34 (911) 555-1234 IBAN DE89 3704 0044 0532 0130 00."
    b = "4111 1111 1111 1111 ana.b@host.example.com 300.1.1.1 2021-02-30 1234567890123456 v2.0 in 1999"
    one, two = (r.text for r in pii.report(spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string"), "key").orderBy("doc_id").collect())
    import re

    cards = re.findall(r"\d(?:[- ]?\d){15}", one.split("IBAN")[0])
    flat = {re.sub(r"\D", "", c) for c in cards}
    assert len(flat) == 1 and re.sub(r"\D", "", two[:19]) in flat and "-" in cards[0]
    digits = [int(c) for c in flat.pop()][::-1]
    assert sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits)) % 10 == 0
    mails = re.findall(r"\S+@\S+\.invalid", one + " " + two)
    assert len(mails) == 2 and mails[0].rstrip(",") == mails[1]
    assert two.endswith("300.1.1.1 2021-02-30 1234567890123456 v2.0 in 1999")
    d1, d2 = re.search(r"(\d\d)/(\d\d)/(\d{4}) \((\d{4}-\d\d-\d\d)\)", one).group(0).replace("(", "").replace(")", "").split()
    assert d1 == "/".join(reversed(d2.split("-"))) and d2 != "2020-02-29"
    assert "10.20.30.40" not in one and "+34 (" in one and "555-1234" not in one
    iban = re.sub(r"\W", "", one.split("IBAN")[1])
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def test_pseudonyms_beside_other_groups(spark):
    """(text, its values by kind, what must not stay in clear)."""
    card, iban = "4111 1111 1111 1111", "BE68 5390 0754 7034"
    cases = [
        (f"pay {card} 12/25", ["card"], [card]), ("card 4111111111111111 123", ["card"], ["4111111111111111"]), ("1 4111-1111-1111-1111", ["card"], ["4111-1111-1111-1111"]),
        ("555-123-4567 555-987-6543", ["phone", "phone"], ["123-4567", "987-6543"]), (f"{iban} EUR", ["iban"], [iban]), ("IBAN BE68539007547034 EUR 20", ["iban"], ["BE68539007547034"]),
        (f"5551 {card}", ["card"], [card]), (f"{card} 12/25/2024", ["card", "date"], [card, "12/25/2024"]), (f"{card} 10.20.30.40", ["card", "ip"], [card, "10.20.30.40"]),
        (f"{iban} GB82 WEST 1234 5698 7654 32", ["iban", "iban"], [iban, "1234 5698 7654 32"]), (f"{iban} {card} 555-123-4567", ["iban", "card", "phone"], [iban, card, "123-4567"]),
        (f"+44 20 7946 0958 {card}", ["phone", "card"], ["7946 0958", card]), (f"{iban} BOB.SMITH@EXAMPLE.COM", ["iban", "email"], [iban, "BOB"]), (f"{card} 555-12-3456", ["card", "tax"], [card, "12-3456"]),
        (f"{card} 555.123.4567", ["card", "phone"], [card, "123.4567"]), ("41 11111111111111 12", ["card"], ["41 11111111111111"]), ("born 1/2/1984, 3.4.1985 and 1986-5-6", ["date"] * 3, ["1/2/1984", "3.4.1985", "1986-5-6"]),
        ("4111 1111 1111 1112", [], []), ("AB12 SOME WORDS IN CAPITALS 2024", [], []), ("7 " * 5_000, None, []),
    ]
    rows = pii.pseudonymised(spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(cases)], "doc_id long, text string"), "key").collect()
    for r in rows:
        text, kinds, gone = cases[r.doc_id]
        assert kinds is None or list(r["__p_found"]) == kinds, text
        assert not [g for g in gone if g in r.text], (text, r.text)
        if kinds == []:
            assert r.text == text
    new = {r.doc_id: r.text for r in rows}
    assert new[0][4:23].replace(" ", "") == new[1].split()[1] == new[2][2:].replace("-", "") and new[0].endswith(" 12/25") and new[4].endswith(" EUR")


def test_pseudonyms_equal_plain_version(docs):
    """The whole query: kinds and new text of every document."""
    got = pii.pseudonymised(docs.select("doc_id", "text"), "key", into="new").collect()
    for r in got:
        assert plain.pseudonymised(r.text or "", "key") == (list(r["__p_found"]), r.new or ""), r.doc_id
    assert sum(len(r["__p_found"]) for r in got) > 20


def test_pseudonyms_of_one_number_are_linked(spark):
    """A number gives one pseudonym in all its spellings, with or without its country."""
    spelt = [["+34 911 555 123", "+34911555123", "+34-911-555-123", "+34 91 155 51 23", "+34.911.555.123"], ["(911) 555-1234", "911-555-1234", "+1 911 555 1234", "+1 (911) 555-1234", "+19115551234"]]
    for group, code in zip(spelt, ("34", "1")):
        rows = pii.pseudonymised(spark.createDataFrame([(i, t) for i, t in enumerate(group)], "doc_id long, text string"), "key").collect()
        digits = {"".join(c for c in r.text if c.isdigit()) for r in rows}
        assert all(list(r["__p_found"]) == ["phone"] for r in rows)
        national = {d[len(code) :] if r.text.startswith("+") else d for r in rows for d in ["".join(c for c in r.text if c.isdigit())]}
        assert len(national) == 1 and all(d.startswith(code) for r in rows for d in ["".join(c for c in r.text if c.isdigit())] if r.text.startswith("+")) and len(digits) <= 2


def test_tax_numbers_stay_valid(spark):
    """Every pseudonym passes the check that its original passed, whatever the number; none is given twice."""
    n = F.col("id") * 222_199  # over all areas, with the borders below
    area = n % 899 + 1
    made = spark.range(4_000).select(F.concat_ws("-", F.lpad(area.cast("string"), 3, "0"), F.lpad((F.floor(n / 899) % 99 + 1).cast("string"), 2, "0"), F.lpad((n % 9999 + 1).cast("string"), 4, "0")).alias("m")).filter("m NOT LIKE '666%'")
    edges = spark.createDataFrame([(m,) for m in ("001-01-0001", "665-99-9999", "667-01-0001", "899-99-9999")], "m string")
    rows = made.union(edges).distinct().withColumn("new", pii.pseudonym("key", F.lit("tax"), F.col("m"))).withColumn("kind", pii.kind_of(F.col("new"))).collect()
    assert len(rows) > 3_900 and {r.kind for r in rows} == {"tax"} and len({r.new for r in rows}) == len(rows)
    assert all(r.new == plain.pseudonym("key", "tax", r.m) for r in rows)
    assert any(not r.new.startswith(r.m[:3]) for r in rows)


def test_mailboxes_of_hosts_in_other_letters(spark):
    """Hosts with letters beyond ASCII are found whole; signs after a host end it, and an ASCII host ends as before."""
    cases = [("иван@пример.рф", ""), ("<ana@bücher.example>", "<>"), ("mail a@例え.テスト。 next", "mail 。 next"), ("b@host.com和", "和"), ("b@host.com—end", "—end"), ("c@münchen.de, d@host.org", ", "), ("x@y @ пример", None)]
    rows = pii.pseudonymised(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string"), "key").orderBy("doc_id").collect()
    import re

    for r, (text, left) in zip(rows, cases):
        assert r.text == text if left is None else re.sub(r"u[a-p]{24}@d[a-p]{16}\.invalid", "", r.text) == left, (text, r.text)
        assert plain.pseudonymised(text, "key") == (list(r["__p_found"]), r.text)


def test_pseudonyms_of_extreme_texts(spark):
    """Nothing deepens the matcher's stack, and a token without digits is found in a text without any."""
    token = "abcdef" * 5 + "ab"
    texts = ["x@" + "a." * 100_000 + "1", "x@" + "ab." * 100_000 + "1", "@" * 300_000, "a@" * 100_000, "1" * 300_000, "-" * 300_000, "1.1." * 80_000, "A" * 300_000, "+1 " * 80_000, f"a token {token} alone"]
    rows = pii.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "key").orderBy("doc_id").collect()
    assert [r.n_values for r in rows] == [0, 1, 0, 0, 0, 0, 0, 0, 0, 1] and token not in rows[-1].text and rows[0].text == texts[0]


def test_pseudonyms_odd_rows(odd_docs, no_docs):
    out = pii.replaced(odd_docs, "key", count_col="n_chars")
    assert out.columns == odd_docs.columns and out.count() == 12 and pii.replaced(no_docs, "key").count() == 0
    assert sorted(str(r.text) for r in out.collect()) == sorted(str(r.text) for r in odd_docs.collect())


# --- 7 ---


def test_repeat_groups_small_strings():
    from collections import Counter

    r = random.Random(5)
    for _ in range(200):
        blobs = [bytes(r.choice(b"ab") for _ in range(r.randint(4, 30))) for _ in range(r.randint(1, 6))]
        counts = [len(b) - 3 for b in blobs]
        blob, place, groups, best = repeats.repeat_groups(blobs, counts, 4)
        seen = Counter(b[i : i + 4] for b in blobs for i in range(len(b) - 3))
        for i, b in enumerate(blobs):
            want = {k for p in range(len(b) - 3) if seen[b[p : p + 4]] > 1 for k in range(p, p + 4)}
            assert want == {k for x, p, n in zip(blob, place, best) if x == i for k in range(p, p + n)}
        for a, b, n in groups:
            words = [blobs[blob[x]][place[x] : place[x] + n] for x in range(a, b + 1)]
            text = words[0]
            assert set(words) == {text} and len(words) >= 2
            everywhere = [(i, p) for i, s in enumerate(blobs) for p in range(len(s) - n + 1) if s[p : p + n] == text]
            assert sorted(everywhere) == sorted((int(blob[x]), int(place[x])) for x in range(a, b + 1))


def mutated(n, seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 8)))
    base = [word() for _ in range(160)]
    passage = " ".join(word() for _ in range(70))
    out = []
    for i in range(n):
        kind = i % 4
        if kind == 0:
            w = [x if r.random() > 0.02 else word() for x in base]
        elif kind == 1:
            w = [word() for _ in range(60)] + [passage] + [word() for _ in range(r.randint(0, 60))]
        elif kind == 2:
            w = [word() for _ in range(r.randint(0, 200))]
        else:
            w = ["ab"] * r.randint(50, 300)
        out.append((i, " ".join(w)))
    return out + [(n, out[0][1]), (n + 1, None), (n + 2, "a" * 5000)]


@pytest.mark.parametrize("wide,huge", [(1_000, 200_000), (3, 200_000), (1, 2)])
def test_removal_against_brute_force(spark, monkeypatch, wide, huge):
    monkeypatch.setattr(repeats, "WIDE", wide)
    monkeypatch.setattr(repeats, "HUGE", huge)
    rows = mutated(60, 7)
    got = {r.doc_id: tuple(r)[1:] for r in repeats.removal_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    want = plain.removal([t for _, t in rows], 200)
    assert [got[i] for i, _ in rows] == want


@pytest.mark.parametrize("length", [64, 333, 600])
def test_removal_of_other_lengths(spark, length):
    rows = mutated(24, 11)
    got = {r.doc_id: tuple(r)[1:] for r in repeats.removal_report(spark.createDataFrame(rows, "doc_id long, text string"), min_len=length).collect()}
    assert [got[i] for i, _ in rows] == plain.removal([t for _, t in rows], length)
    with pytest.raises(ValueError):
        repeats.covered_ranges(spark.createDataFrame(rows, "doc_id long, text string"), min_len=63)


@pytest.mark.parametrize("wide,huge", [(1_000, 200_000), (3, 200_000), (1, 2)])
def test_groups_have_all_occurrences(spark, monkeypatch, wide, huge):
    """Each group is one string with every place where it stands; together they cover what is removed; long copies are one group."""
    monkeypatch.setattr(repeats, "WIDE", wide)
    monkeypatch.setattr(repeats, "HUGE", huge)
    rows = [(i, t) for i, t in mutated(28, 5) if t is not None]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    raw = {i: t.encode() for i, t in rows}
    found = {}
    for r in repeats.groups(df).collect():
        found.setdefault(r.group, []).append(r)
    gone = {i: np.zeros(len(b), bool) for i, b in raw.items()}
    for g in found.values():
        n = g[0].length
        text = raw[g[0].doc_id][g[0].start : g[0].start + n]
        everywhere = sorted((i, p) for i, b in raw.items() for p in range(len(b) - n + 1) if b.startswith(text, p))
        assert len(text) == n >= 200 and len(everywhere) >= 2 == len({2, g[0].n_occurrences > 1})
        assert everywhere == sorted((r.doc_id, r.start) for r in g) and g[0].n_occurrences == len(g)
        for i, p in everywhere:
            gone[i][p : p + n] = True
    removed = {i: r[1] for (i, _), r in zip(rows, plain.removal([t for _, t in rows], 200))}
    assert {i: int(x.sum()) for i, x in gone.items()} == removed


def test_groups_join_spans(spark):
    """A passage of many spans in two documents is one group."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8)))
    passage = " ".join(word() for _ in range(400))
    rows = [(i, " ".join(word() for _ in range(80)) + f" {i} {passage} {i} " + " ".join(word() for _ in range(80))) for i in range(2)]
    got = repeats.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    longest = max(r.length for r in got)
    assert longest >= len(passage) - 400 and len({r.group for r in got}) <= 4


def test_removal_of_large_rows_in_parts(monkeypatch):
    monkeypatch.setattr(repeats, "LARGE", 2000)
    monkeypatch.setattr(repeats, "STEP", 700)
    r = np.random.default_rng(3)
    body = r.integers(97, 123, 9000, dtype=np.uint8)
    whole = repeats.spans_of(body, np.array([0, len(body)]), 200)
    parts = list(repeats._pieces(body, np.array([0, len(body)]), 200))
    assert len(parts) == 13
    windows = lambda found: {(s + i, a) for row, start, count, anchor, _ in found for s, c, a in zip(start, count, anchor) for i in range(c)}
    assert windows(parts) == windows([whole]) and len({w for w, _ in windows(parts)}) == 9000 - 199


def test_removal_odd_rows(odd_docs, no_docs):
    got = sorted((tuple(r)[1:] for r in repeats.removal_report(odd_docs).collect()), key=str)
    assert got == sorted(plain.removal([r.text for r in odd_docs.collect()], 200), key=str)
    assert repeats.removal_report(no_docs).count() == 0 and repeats.remove_repeats(no_docs).count() == 0
    out = repeats.remove_repeats(odd_docs, count_col="n_chars")
    assert out.columns == odd_docs.columns and {r.text for r in out.filter("doc_id = 4").collect()} == {""}


# --- 8 ---


def test_neighbours_recall_and_scores(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    data = table.toPandas()
    x, ids = np.stack(data.embedding).astype(float), data.vec_id.to_numpy()
    got = ann.neighbours(table, every=10).toPandas()
    hit = 0
    asked = np.flatnonzero(ids % 10 == 0)
    for q in asked:
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        best = [i for i in np.lexsort((ids, d)) if i != q][:10]
        mine = got[got.query_id == ids[q]].sort_values("rank")
        hit += len(set(mine.vec_id) & set(ids[best]))
        assert list(mine["rank"]) == list(range(1, 11)) and list(mine.score) == sorted(mine.score)
        assert all(abs(d[ids == v][0] - s) < 1e-12 for v, s in zip(mine.vec_id, mine.score))
    assert hit / len(asked) / 10 > 0.9


def test_neighbours_read_little_of_clustered_vectors():
    """Of 20,000 clustered vectors a query reads under a tenth and finds over 95 % of its neighbours."""
    r = np.random.default_rng(0)
    x = (r.normal(size=(300, 32)) * 3)[r.integers(0, 300, 20_000)] + r.normal(size=(20_000, 32))
    index = ann.Index.build(x[r.permutation(len(x))[: ann.SAMPLE]])
    members = [[] for _ in index.centroids]
    for i, lists in enumerate(index.search(x, ann.CLOSURE, ann.COPIES)):
        for c in lists:
            members[c].append(i)
    hit, read = [], []
    for q, lists in zip(x[::200], index.search(x[::200], index.ratio)):
        got = np.unique(np.concatenate([members[c] for c in lists]))
        best = np.argsort(((x - q) ** 2).sum(1), kind="stable")[1:11]
        hit.append(np.isin(best, got).mean())
        read.append(len(got) / len(x))
    assert np.mean(hit) >= 0.95 and np.mean(read) < 0.1


def test_neighbours_ties_of_long_vectors(spark):
    """Equal distances of vectors far from the origin go by id, and columns named like those inside play no part."""
    rows = [(i, [1e8 + (1.0 if i % 2 else -1.0) * (i > 0), 1e8]) for i in range(41)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for c in ("v", "ids", "vh", "list", "qid", "qh", "d", "r", "s", "q", "ns", "nq", "top", "own", "rank", "score", "query_id"):
        df = df.withColumn(c, F.lit(c))
    got = ann.neighbours(df, every=100).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(i, 1.0) for i in range(1, 11)]


def test_neighbours_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0]), (None, [1.0, 1.0]), (9, [0.0, 1.0]), (9, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {(r.query_id, r["rank"]): (r.vec_id, round(r.score, 6)) for r in ann.neighbours(df, k=4).collect()}
    far = round(math.sqrt(2), 6)
    assert got == {(0, 1): (1, 0.0), (0, 2): (100, 0.0), (0, 3): (2, far), (0, 4): (9, far), (100, 1): (0, 0.0), (100, 2): (1, 0.0), (100, 3): (2, far), (100, 4): (9, far)}
    assert ann.neighbours(df.limit(0)).count() == 0
    many = spark.range(0, 301).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0)).cast("array<float>").alias("embedding"))
    rows = ann.neighbours(many).filter("query_id = 300").orderBy("rank").collect()
    assert [r.vec_id for r in rows] == list(range(10)) and {r.score for r in rows} == {0.0}


# --- 9 ---


@pytest.mark.parametrize("small,unit,part", [(256, 2048, 20_000), (4, 7, 20_000), (4, 7, 6)])
def test_near_duplicates_against_brute_force(spark, monkeypatch, small, unit, part):
    monkeypatch.setattr(ngram_join, "SMALL", small)
    monkeypatch.setattr(ngram_join, "PART", part)
    monkeypatch.setattr(ngram_join, "UNIT", unit)
    rows = mutated(80, 11) + [(200 + i, t) for i, t in mutated(40, 12)] + [(300, "one two"), (301, "One, two!"), (302, ""), (303, None), (304, "three")]
    got = {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain.near(rows)


def test_near_duplicates_sample_table(spark):
    big = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in ngram_join.near_duplicates(big).collect()}
    assert got == plain.near([(r.doc_id, r.text) for r in big.collect()])


def test_keep_one_odd_rows(odd_docs, no_docs):
    out = ngram_join.keep_one(odd_docs)
    assert out.columns == odd_docs.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(["1", "2", "3", "None", "4", "6", "7", "8", "9", "10"])
    assert ngram_join.keep_one(no_docs).count() == 0 and ngram_join.near_duplicates(no_docs).count() == 0


def test_keep_one_of_one_id(spark):
    """Near copies under one id leave one row; of repeated rows the choice depends on their columns alone."""
    a, b = ("one two three four five six seven eight nine ten eleven twelve thirteen fourteen " * 3 + end for end in ("fifteen", "sixteen"))
    rows = [(6, a, "x"), (6, b, "x"), (7, b, "x"), (8, "other words alone", "q"), (8, "other words alone", "p"), (None, "no id", "x"), (None, "no id", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, v string")
    one = sorted(map(str, ngram_join.keep_one(df).collect()))
    assert len(one) == 3 and one == sorted(map(str, ngram_join.keep_one(df.repartition(3).orderBy(F.desc("v"))).collect()))


@pytest.mark.parametrize("name", ["op7_suffix_array_dedup", "op9_ngram_jaccard_join"])
def test_query_matches_sql(spark, duck, name):
    got, rel = queries.QUERIES[name](spark, SF), duck.sql(queries.ORACLE_SQL[name])
    assert sorted(rel.columns) == sorted(got.columns)
    assert sorted(tuple(r[c] for c in rel.columns) for r in got.collect()) == sorted(rel.fetchall())


def test_pruning_bound():
    from math import comb

    for n, t, tol in ((32, 0.8, 1e-4), (96, 0.8, 1e-4), (64, 0.6, 1e-3)):
        p = t + (1 - t) / 256
        tail = lambda m, n=n, p=p: sum(comb(n + 1, k) * p**k * (1 - p) ** (n + 1 - k) for k in range(m + 1))
        m = ngram_join.least_matches(n, t, tol)
        assert tail(m) >= tol > tail(m - 1)


def test_components_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(500, 500)]
    got = components.components(spark.createDataFrame(edges, "u long, v long"))
    assert {(r.node, r.root) for r in got.collect()} == {(i, 0) for i in range(41)} | {(i, 100) for i in range(100, 140)}


def test_components_unsettled_is_an_error(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "u long, v long")
    with pytest.raises(RuntimeError):
        components.components(edges, most_rounds=1)


# --- 10 ---


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_file("word_bpe_49k.json"))


def check_packed(rows, texts, tokenizer, size=4096):
    """Pieces cover each document once, windows have no gaps, digests are right; gives windows."""
    ids = {k: tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for k, t in texts.items()}
    windows, parts = {}, {}
    for r in rows:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
        parts.setdefault(r.doc_id, []).append((r.start, r.length))
        piece = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert r.ids_crc32 == zlib.crc32(piece.tobytes()) and r.doc_tokens == len(ids[r.doc_id]) and r.length > 0
    for own, total in ((windows, None), (parts, ids)):
        for k, spans in own.items():
            spans.sort()
            assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
            end = spans[-1][0] + spans[-1][1]
            assert end <= size if total is None else end == len(total[k])
    assert set(parts) == set(ids)
    return [sum(n for _, n in s) for s in windows.values()]


def test_packing_is_whole(docs, tokenizer):
    texts = {r.doc_id: r.text for r in docs.collect()}
    sizes = check_packed(packing.pack(docs, queries.tokenizer_file("word_bpe_49k.json")).collect(), texts, tokenizer)
    assert sum(s < 4096 for s in sizes) <= 1


def test_packing_goes_on_in_rounds(docs, tokenizer, monkeypatch):
    """Many small tasks, three rounds: still one padded window, and most windows are closed before the last pouring."""
    monkeypatch.setattr(packing, "TASKS", 2)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = packing.pack(docs.repartition(7), queries.tokenizer_file("word_bpe_49k.json")).collect()
    assert sum(s < 4096 for s in check_packed(rows, texts, tokenizer)) <= 1
    assert {r.sequence_id >> 58 for r in rows} >= {0, 3}


def test_packer_over_its_bound():
    p = packing.Packer(64, most_open=5)
    windows = [w for i in range(200) for w in p.place(i, b"\0\0\0\0" * 40)] + list(p.flush())
    assert sum(len(x[2]) for w in windows for x in w) == 200 * 160 and sum(sum(len(x[2]) for x in w) < 256 for w in windows) <= 1


def test_other_tokenizer_goes_whole(tmp_path, tokenizer):
    """A file that parts words in another way is not taken for the one the fast path knows."""
    import json

    told = json.loads(tokenizer.to_str())
    told["normalizer"] = None
    path = tmp_path / "other.json"
    path.write_text(json.dumps(told))
    from tokenizers import Tokenizer

    enc, own = packing.WordEncoder(str(path)), Tokenizer.from_file(str(path))
    assert not enc.fast and packing.WordEncoder(queries.tokenizer_file("word_bpe_49k.json")).fast
    assert enc.encode(["Hello World's 12"]) == [np.array(own.encode("Hello World's 12", add_special_tokens=False).ids, "<u4").tobytes()]


def test_packing_odd_rows(odd_docs, no_docs, tokenizer):
    path = queries.tokenizer_file("word_bpe_49k.json")
    once = odd_docs.filter("doc_id IS NULL OR doc_id <> 6")
    check_packed(packing.pack(once, path).collect(), {r.doc_id: r.text for r in once.collect()}, tokenizer)
    rows = packing.pack(odd_docs.filter("doc_id = 6"), path).collect()
    assert len(rows) == 2 and packing.pack(no_docs, path).count() == 0


def test_word_encoder_matches_tokenizer(tokenizer):
    enc = packing.WordEncoder(queries.tokenizer_file("word_bpe_49k.json"), most=50)
    texts = ["Don't STOP'S it's ''s 12½ naïve ÀÉ × ÷ ß µª", "<|endoftext|> x", "Σας ΤΙΣ", "b́ İ", "日本", "\x1c\x1fa\x0b", "", "a b", "'Tis 'LL 're" * 3, "²x³ " * 9]
    for _ in range(2):
        assert enc.encode(texts) == [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_levels_choose_least_squares():
    r = random.Random(2)
    p = packing.Packer(64, most_open=10**6)
    for i in range(400):
        n = r.randint(1, 63)
        levels = p.levels.copy()

        def after(h, n=n, levels=levels):
            x = levels.copy()
            if h:
                x[h] -= 1
            if h + n < 64:
                x[h + n] += 1
            return int((x[1:64] ** 2).sum())

        at = p.choose(n)
        assert after(at) == min(after(h) for h in range(64 - n + 1) if h == 0 or levels[h])
        list(p.place(i, b"\0\0\0\0" * n))
        assert p.levels[64] == 0 and all(len(p.open.get(h, [])) == p.levels[h] for h in range(1, 64))
    assert all(sum(len(x[2]) for x in w) <= 256 for w in p.flush())


# --- pipeline and queries ---


def test_pipeline_against_stages(spark, docs, tokenizer):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, SF).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = {r.doc_id for r in quality.judged(docs.select("doc_id", "text")).filter("kept").collect()}
    near = plain.near([(i, texts[i]) for i in sorted(kept)])
    kept = sorted(i for i in kept if near[i][0] == i)
    rest = repeats.remove_repeats(docs.filter(F.col("doc_id").isin(kept)), count_col="n_chars")
    want = plain.removal([texts[i] for i in kept], 200)
    left = {r.doc_id: r.text for r in rest.collect()}
    import hashlib

    assert all(gone or left[i] == texts[i] for i, (_, gone, _, _) in zip(kept, want))
    assert sum(hashlib.sha256(left[i].encode()).hexdigest() == w[3] for i, w in zip(kept, want)) >= len(kept) - 2  # but for cut code points
    final = {r.doc_id: r.text for r in pii.replaced(rest, queries.PSEUDONYM_KEY).collect()}
    check_packed(rows, final, tokenizer)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_jaccard_join", "suffix_array_dedup", "pii", "packing"]


def test_stages_keep_columns(spark, docs):
    import corpus_pipeline

    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert dict(out.dtypes) == dict(docs.dtypes) and out.count() <= docs.count()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0
