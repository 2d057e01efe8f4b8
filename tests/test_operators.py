"""Operators on small fixtures with ties, nulls and borders, against plain loops."""

import itertools
import random
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.functions import labels, names, nulls, text
from parlance.operators import audits, evaluation, fusion, intervals, keywords, matching, prosody, providers, roles, sentiment, voiceprint
from parlance.sources import audio, tables
from parlance.streaming.sessions import merged_sessions


def segments(spark, rows):
    return spark.createDataFrame(rows, "audio_id string, seg_id int, start_s double, end_s double, speaker string")


def random_segments(n, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        a = r.randrange(0, 200) / 4
        out.append((r.choice("xy"), i, a, a + r.randrange(0, 30) / 4, r.choice(["A", "B", None])))
    return out


def test_merge_adjacent_against_loop(spark):
    rows = random_segments(300, 1)
    got = sorted((r.audio_id, r.start_s, r.end_s, r.n_merged, r.merged_ids) for r in intervals.merge_adjacent(segments(spark, rows), max_gap=0.5).collect())
    want = []
    for a in "xy":
        now = None
        for row in sorted((r for r in rows if r[0] == a), key=lambda r: (r[2], r[3], r[1])):
            same = now is not None and now["sp"] is not None and now["sp"] == row[4] and row[2] - now["end"] <= 0.5
            if same:
                now["end"] = max(now["end"], row[3])
                now["ids"].append(row[1])
            else:
                if now:
                    want.append((a, now["start"], now["end"], len(now["ids"]), ",".join(map(str, now["ids"]))))
                now = {"sp": row[4], "start": row[2], "end": row[3], "ids": [row[1]]}
        want.append((a, now["start"], now["end"], len(now["ids"]), ",".join(map(str, now["ids"]))))
    assert got == sorted(want)


@pytest.mark.parametrize("bin_s", [None, 3.0])
def test_overlap_regions_and_seconds_against_loop(spark, bin_s):
    rows = random_segments(120, 2)
    df = segments(spark, rows)
    regions = intervals.overlap_regions(df)
    want = []
    for a in "xy":
        busy = [t for t in range(0, 1000) if sum(r[0] == a and r[2] * 4 <= t < r[3] * 4 for r in rows) > 1]
        for _, g in itertools.groupby(enumerate(busy), key=lambda x: x[1] - x[0]):
            g = [x[1] for x in g]
            want.append((a, g[0] / 4, (g[-1] + 1) / 4))
    assert sorted(map(tuple, regions.select("audio_id", "start_s", "end_s").collect())) == sorted(want)
    got = {r.seg_id: r.overlap_s for r in intervals.overlap_seconds(df, regions, bin_s=bin_s).collect()}
    for r in rows:
        assert got[r[1]] == pytest.approx(sum(max(0, min(r[3], b) - max(r[2], a)) for k, a, b in want if k == r[0]))


def test_scored_reasons_and_anchors(spark):
    df = spark.createDataFrame([("x", 1, 0.0, 3.0, "A", -10.0, 0.0), ("x", 2, 5.0, 5.5, "A", None, 0.0), ("x", 3, 6.0, 8.0, "A", -50.0, 1.0), ("x", 4, 9.0, 12.0, "A", -10.0, 0.0), ("x", 5, 20.0, 23.0, "A", -5.0, 0.0)], "audio_id string, seg_id int, start_s double, end_s double, speaker string, rms double, overlap_s double")
    out = {r.seg_id: r for r in intervals.scored(df).collect()}
    assert out[1].anchor_reasons == "initial_window" and out[1].valid_export and not out[1].valid_anchor
    assert out[2].drop_reasons == "short" and out[2].anchor_reasons == "short;short_anchor"
    assert out[3].drop_reasons == "low_energy" and out[3].anchor_reasons == "low_energy;overlap"
    assert [r.seg_id for r in intervals.anchors(intervals.scored(df), n=1).collect()] == [5]


def test_assign_points_rules(spark):
    segs = segments(spark, [("x", 1, 0.0, 2.0, "A"), ("x", 2, 2.0, 4.0, "B"), ("x", 3, 10.0, 11.0, "A")])
    words = spark.createDataFrame([("x", 1, 1.5, 2.5), ("x", 2, 4.1, 4.3), ("x", 3, 6.0, 6.2), ("y", 4, 0.0, 1.0), ("x", 5, 1.9, 2.4)], "audio_id string, word_id int, w_start double, w_end double")
    got = {r.word_id: (r.seg_id, r.how) for r in intervals.assign_points(words, segs).collect()}
    assert got == {1: (1, "overlap"), 2: (2, "nearest"), 3: (None, "none"), 4: (None, "none"), 5: (2, "overlap")}
    assert {r.word_id: r.seg_id for r in intervals.assign_points(words, segs, tolerance=None).collect()}[3] == 2


def test_relabel_and_best(spark):
    df = spark.createDataFrame([(1, "a", 0.1, 0.2), (2, "a", 0.2, 0.195), (3, None, float("nan"), 0.3), (4, "a", None, None)], "i int, original string, a double, b double")
    best, second, _, margin = intervals.best_by_distance({"a": F.col("a"), "b": F.col("b")})
    label, moved = intervals.relabel(F.col("original"), best, margin, F.lit(0.01))
    got = {r.i: (r.x, r.m) for r in df.select("i", label.alias("x"), moved.alias("m")).collect()}
    assert got == {1: ("a", False), 2: ("a", False), 3: (None, True), 4: ("a", False)}
    with pytest.raises(ValueError):
        intervals.best_by_distance({"a": F.col("a")})


def test_evidence_stops_after_crossing(spark):
    rows = [("x", "A", i, float(i), 5, 10.0, 0.0, f"t{i}") for i in range(6)]
    df = spark.createDataFrame(rows, "audio_id string, speaker string, seg_id int, start_s double, n_words int, duration_s double, overlap_ratio double, text string")
    one = roles.evidence(df, ["audio_id", "speaker"]).first()
    assert (one.n_rows, one.evidence_text, one.seconds) == (3, "t0 t1 t2", 30.0)


def test_turns(spark):
    t = "hello there\r\nAgente 1: good morning, how may I help\nstill me\nCLIENTE - my line is down since monday\nCustomer: ok\nUsuario_2: I would like to cancel it now"
    got = [(r.turn, r.role, r.turn_text) for r in roles.official_turns(spark.createDataFrame([(1, t), (2, None)], "k int, t string"), "k", "t").orderBy("turn").collect()]
    assert got == [(0, "AGENT", "good morning, how may I help still me"), (1, "CLIENT", "my line is down since monday"), (2, "CLIENT", "I would like to cancel it now")]


def test_role_pairs(spark):
    s = spark.createDataFrame([(1, "a", "AGENT", 9, 0.2), (1, "a", "CLIENT", 9, 0.8), (1, "b", "AGENT", 5, 0.7), (1, "b", "CLIENT", 5, 0.1), (1, "c", "AGENT", 1, 1.0), (2, "a", "AGENT", 1, 0.5)], "k int, speaker string, role string, evidence int, score double")
    got = {r.k: (r.agent_speaker, r.client_speaker, r.status) for r in roles.role_pairs(s, "k").collect()}
    assert got == {1: ("b", "a", "accepted_speaker_role"), 2: ("a", None, "less_than_two_speakers_with_evidence")}


def test_gram_weights_are_unit(spark):
    df = spark.createDataFrame([(1, "a", "ab abc"), (1, "b", "abc d"), (2, "a", "zz")], "g int, id string, t string")
    w = roles.gram_weights(df, ["g"], "id", "t")
    assert [round(r.s, 9) for r in w.groupBy("g", "id").agg(F.sum(F.col("w") * F.col("w")).alias("s")).collect()] == [1.0] * 3
    grams = {r.gram for r in w.filter("g = 1 AND id = 'b'").collect()}
    assert grams == {" ab", "abc", "bc ", " abc", "abc ", " abc ", " d "}


def test_role_scores_identical_text(spark):
    e = spark.createDataFrame([(1, "a", "one two three", 3), (1, "b", "", 0)], "k int, speaker string, evidence_text string, n_words int")
    o = spark.createDataFrame([(1, "AGENT", "one two three")], "k int, role string, role_text string")
    got = {r.speaker: r.score for r in roles.role_scores(e, o, "k").collect()}
    assert got["a"] == pytest.approx(1.0) and got["b"] == 0.0


def test_text_functions(spark):
    df = spark.createDataFrame([("  ¡Ñandú, ÇA va?  ",), (None,), ("a,b",)], "t string")
    assert [r.x for r in df.select(text.normalize_text(F.col("t")).alias("x")).collect()] == ["nandu ca va", "", "a b"]
    one = spark.range(1).select(text.joined_words(F.array(F.lit(" hola"), F.lit(" ,"), F.lit(" que"))).alias("a"), text.clock(F.lit(59.6)).alias("b"), text.clock_hundredths(F.lit(61.5)).alias("c"), text.salted_hash(F.lit(None).cast("string"), "s").alias("d")).first()
    assert (one.a, one.b, one.c, one.d) == ("hola, que", "00:60", "01:01.50", None)


def test_names(spark):
    df = spark.createDataFrame([("raw_bajas_123_clean.wav",), ("/p/bajas_raw_9_final_merged.csv",), ("x0123456789raw_",), ("abc.mp3",)], "n string")
    source, number = names.source_and_id(F.col("n"))
    got = [tuple(r) for r in df.select(names.recording_id(F.col("n")), names.consolidation_id(F.col("n")), source, number).collect()]
    assert got == [("123", "123", "raw_bajas", "123"), ("bajas_raw_9", "9", None, None), ("x0123456789raw_", "x0123456789raw_", "raw", "0123456789"), ("abc.mp3", "abc.mp3", None, None)]


def test_labels_and_nulls(spark):
    df = spark.createDataFrame([("Négativo",), ("5 stars",), ("odd",), (None,)], "x string")
    assert [r[0] for r in df.select(labels.sentiment_label(F.col("x"))).collect()] == ["négativo", "5 stars", "odd", None]
    assert [r[0] for r in df.select(labels.spanish_label(F.col("x"))).collect()] == ["négativo", "positivo", "odd", None]
    one = spark.range(1).select(nulls.changed(F.lit(None), F.lit(1)).alias("a"), nulls.known(F.lit(float("nan"))).alias("b"), nulls.truthy(F.lit("Yes")).alias("c"), nulls.first_text(F.lit("<NA>")).alias("d"), labels.call_phase(F.lit(None).cast("double")).alias("e")).first()
    assert (one.a, one.b, one.c, one.d, one.e) == (True, None, True, None, "unknown")


def test_cascade_and_lookup_and_time_join(spark):
    left = spark.createDataFrame([(1, "k1", "d1", 10.0), (2, "k2", "d9", 10.0), (3, "k3", "d9", 10.0), (4, "k4", "d1", 1.0)], "i int, lk string, ld string, ls double")
    right = spark.createDataFrame([("k1", "d1", 99.0, "a"), ("k1", "d2", 10.0, "b"), ("k2", "d1", 50.0, "c"), ("k3", "d1", 13.0, "d"), ("k3", "d2", 8.0, "e")], "rk string, rd string, rs double, name string")
    got = {r.i: (r.name, r.method) for r in matching.cascade_match(left, right, "i", [("ld", "rd")], ("lk", "rk"), ("ls", "rs"), "name").collect()}
    assert got == {1: ("a", "exact"), 2: ("c", "unique"), 3: ("e", "nearest"), 4: (None, "none")}
    a = spark.createDataFrame([("x", 1.0004, 2.0), (None, None, 2.0)], "audio_id string, start_s double, end_s double")
    b = spark.createDataFrame([("x", 1.0, 2.0, "l"), (None, None, 2.0, "m"), ("x", 1.0, 2.0, "k")], "audio_id string, start_s double, end_s double, lab string")
    assert sorted((r.audio_id or "", r.lab) for r in matching.time_key_join(a, b, ["audio_id"]).collect()) == [("", "m"), ("x", "k")]
    assert matching.resolve_column(a, ["z", "end_s"]) == "end_s"
    with pytest.raises(KeyError):
        matching.resolve_column(a, ["z"], required=True)


def test_keywords_rank_and_sentiment(spark):
    df = spark.createDataFrame([("c1", 0, "Quiero la BAJA, trabajar"), ("c1", 1, ""), ("c2", 0, None), ("c3", 0, "factura")], "audio_id string, seg_id int, text string")
    lex = {"baja": ["baja"], "cobros": ["factura", "cobro"]}
    s = keywords.spotted(df, lex)
    assert s.filter("seg_id = 0 AND audio_id = 'c1'").first().kw_baja_matched == ["baja"]
    calls = {r.audio_id: r for r in keywords.by_call(s, lex, ["audio_id"]).collect()}
    assert calls["c2"].score == 0 and calls["c2"].percentile == pytest.approx(0.3333) and calls["c3"].percentile == 1.0
    assert calls["c1"].themes == ["baja"]


def test_scaling_without_spread(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (2, 1.0, 5.0), (3, 4.0, 5.0), (4, None, None)], "i int, a double, b double")
    got = {r.i: (r.z_a, r.z_b) for r in prosody.robust_scaled(df, ["a", "b"]).collect()}
    assert got[1][1] == 0.0 and got[4] == (None, None) and got[3][0] == pytest.approx(2 / np.std([1, 1, 4], ddof=1))
    assert prosody.scaled_01(df.select("i", "b"), ["b"]).first().b is None


def test_p_value_known():
    assert fusion.p_value(0.5, 20) == pytest.approx(0.02477, abs=1e-4)
    assert fusion.p_value(0.0, 20) == pytest.approx(1.0, abs=1e-9)


def test_p_values_as_columns(spark):
    rows = spark.createDataFrame([("a", "b", 20, 0.5, None), ("a", "c", 20, 0.0, 1.0)], "x string, y string, n long, pearson double, spearman double")
    one, two = fusion.with_p_values(rows).orderBy("y").collect()
    assert abs(one.p_pearson - fusion.p_value(0.5, 20)) < 1e-12 and one.p_spearman is None and two.p_pearson > 0.99 and two.p_spearman == 0.0


def test_correlations_with_few_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (3.0, None)], "a double, b double")
    one = fusion.correlations(df, [("a", "b")]).first()
    assert (one.n, one.pearson) == (2, None)


def test_roc_against_loops(spark):
    r = random.Random(3)
    rows = [(r.randrange(2), r.randrange(12) / 4) for _ in range(200)]
    df = spark.createDataFrame(rows, "y int, s double")
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    area = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)
    assert evaluation.auc(df).first().auc == pytest.approx(area)
    assert evaluation.auc(df.filter("y = 1")).first().auc is None
    best = max(sorted({s for _, s in rows}), key=lambda t: (round(sum(s >= t for s in pos) / len(pos) - sum(s >= t for s in neg) / len(neg), 12), t))
    assert evaluation.thresholds(df).first().youden_threshold == best


def test_metrics_by_class(spark):
    rows = [("AGENT", "AGENT")] * 3 + [("AGENT", "CLIENT")] * 2 + [("CLIENT", "AGENT")] + [("AGENT", None), ("OTHER", "AGENT"), (None, "AGENT")]
    df = spark.createDataFrame(rows, "role string, predicted string")
    got = {r.role: (r.precision, r.recall, r.f1, r.support) for r in evaluation.by_class(df, "role", "predicted").collect()}
    assert got["AGENT"] == pytest.approx((3 / 6, 3 / 5, 6 / 11, 5)) and got["CLIENT"] == (0.0, 0.0, 0.0, 1)
    table = {(r.truth, r.predicted): r.n for r in evaluation.confusion_by_class(df, "role", "predicted").collect()}
    assert table == {("AGENT", "AGENT"): 3, ("AGENT", "CLIENT"): 2, ("CLIENT", "AGENT"): 1, ("CLIENT", "CLIENT"): 0}
    assert {r.support for r in evaluation.by_class(df.limit(0), "role", "predicted").collect()} == {0}


def test_voice_splits_and_identification(spark):
    rows = [(p, p * 10 + k, providers.stand_in_vector(f"{p}").tolist(), 5.0) for p in range(8) for k in range(4)]
    v = spark.createDataFrame(rows, "person_id int, sample_id int, v array<double>, seconds double")
    persons = v.select("person_id").distinct()
    assert sorted(r["count"] for r in voiceprint.identity_split(persons).groupBy("part").count().collect()) == [3, 5]
    parts = {r.part: r["count"] for r in voiceprint.open_set_split(persons).groupBy("part").count().collect()}
    assert parts == {"unknown": 2, "known_test": 2, "calibration": 4}
    use = voiceprint.call_split(v)
    assert {tuple(r) for r in use.groupBy("person_id", "use").count().select("use", "count").collect()} == {("query", 1), ("enrolment", 3)}
    for pivots in (256, 3):
        found = voiceprint.identified(v, voiceprint.profiles(v), pivots=pivots)
        assert found.filter("best <> truth").count() == 0 and found.count() == 32
    pairs = voiceprint.verification_pairs(v)
    assert {r.same: r["count"] for r in pairs.groupBy("same").count().collect()} == {0: 144, 1: 48}
    assert pairs.dropDuplicates(["a", "b"]).count() == 192


def test_audits_and_sentiment_results(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", 2)], "k string, v int")
    got = {r.k: r.failed_checks for r in audits.audited(df, ["k"], [F.count("*").alias("n"), F.max("v").alias("m")], [audits.Check("two", "n = 2"), audits.Check("big", "m > 1")]).collect()}
    assert got == {"a": "big", "b": "two"}
    assert audits.same_rows(df, df) and not audits.same_rows(df, df.limit(2))
    res = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "k string, at int, lab string")
    assert sentiment.pending(df, res, "k").count() == 1
    assert {r.lab for r in sentiment.merged_results(df, res, "k", F.col("at")).collect()} == {"y", None}


def test_tables_and_audio(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "a int, secret string")
    tables.write_table(df, f"{tmp_path}/t", ["z", "a"], drop=("secret",))
    assert spark.read.parquet(f"{tmp_path}/t").columns == ["z", "a"]
    assert tables.usable(spark, f"{tmp_path}/t", ["a"]) and not tables.usable(spark, f"{tmp_path}/t", ["q"]) and not tables.usable(spark, f"{tmp_path}/none", [])
    assert tables.read_csv_or_empty(spark, f"{tmp_path}/none.csv", df.schema).count() == 0
    calls = []
    for _ in range(2):
        tables.stage(spark, f"{tmp_path}/s", lambda: calls.append(1) or df, ["a"])
    assert len(calls) == 1
    with wave.open(f"{tmp_path}/raw_5_clean.WAV", "wb") as w:
        w.setnchannels(2), w.setsampwidth(2), w.setframerate(8000)
        w.writeframes((np.sin(np.arange(32000) / 5) * 9000).astype("<i2").tobytes())
    (tmp_path / "bad.wav").write_bytes(b"no")
    good, bad = audio.inventory(spark, str(tmp_path))
    one = good.first()
    assert (one.audio_id, one.duration_seconds, one.n_channels) == ("5", 2.0, 2) and bad.count() == 1
    files = audio.wav_files(spark, str(tmp_path)).filter("path LIKE '%raw%'")
    assert providers.applied(files, providers.TurnsOfSeconds, providers.SEGMENT_SCHEMA).count() == 2
    assert providers.applied(files, providers.WordsOfHalfSeconds, providers.WORD_SCHEMA).count() == 4
    line = tables.rttm(spark.createDataFrame([("a", 0.5, 2.0, "S")], "audio_id string, start_s double, end_s double, speaker string")).first().value
    assert line == "SPEAKER a 1 0.500 1.500 <NA> <NA> S <NA> <NA>"


def test_signal_helpers():
    rate = 8000
    x = np.concatenate([np.ones(rate), np.zeros(2 * rate), np.ones(rate)]).astype(np.float32)
    (a, b), *_ = providers.silences(x, rate)
    assert 0.8 < a < 1.3 and 2.7 < b < 3.2
    assert len(providers.shortened(x, rate)) < 3.2 * rate
    assert providers.rms_dbfs(np.zeros(5)) == -120.0 and providers.rms_dbfs(np.ones(5)) == 0.0


def test_sessions_batch_and_stream(spark, tmp_path):
    rows = [("u", "2024-01-01 00:00:00"), ("u", "2024-01-01 00:20:00"), ("u", "2024-01-01 05:00:00"), ("v", "2024-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "k string, t string").withColumn("t", F.to_timestamp("t"))
    want = sorted((r.k, r.n_rows) for r in merged_sessions(df, ["k"], "t").collect())
    assert want == [("u", 1), ("u", 2), ("v", 1)]
    df.write.parquet(f"{tmp_path}/in")
    df.limit(0).union(spark.createDataFrame([("w", "2025-01-01 00:00:00")], "k string, t string").withColumn("t", F.to_timestamp("t"))).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = merged_sessions(stream, ["k"], "t").writeStream.outputMode("append").format("memory").queryName("merged").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert {r.k for r in spark.sql("SELECT k FROM merged").collect()} <= {"u", "v", "w"}
