"""Sources, stages, features of sound and serving."""

import io
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.operators import ranks, reports, sound, voiceprint
from parlance.sources import files, stages, warehouse


def wav(x, rate=8000):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(x, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def test_sound_features_of_known_signals():
    t = np.arange(16000) / 8000
    status, f = sound.sound_features(0.5 * np.sin(2 * np.pi * 200 * t), 8000)
    assert status == "ok" and f["pitch_median"] == pytest.approx(200, rel=0.02) and f["spectral_centroid_mean"] == pytest.approx(200, abs=60) and f["voiced_ratio"] > 0.9
    assert f["rms_audio_mean"] == pytest.approx(0.5 / np.sqrt(2), rel=0.03) and f["zcr_mean"] == pytest.approx(400 / 8000, rel=0.1)
    noise = sound.sound_features(np.random.default_rng(0).normal(size=16000) * 0.1, 8000)[1]
    assert noise["spectral_centroid_mean"] > 1500 and noise["voiced_ratio"] < 0.3
    assert sound.sound_features(np.zeros(100), 8000)[0] == "too_short_audio" and sound.sound_features(np.zeros(8000), 8000)[0] == "silent_audio"


def test_per_segment_providers(spark):
    t = np.arange(16000) / 8000
    content = [("a", wav(0.5 * np.sin(2 * np.pi * 200 * t))), ("b", b"broken")]
    recordings = spark.createDataFrame(content, "audio_id string, content binary")
    segs = spark.createDataFrame([("a", 1, 0.0, 1.0), ("a", 2, 1.5, 1.6), ("b", 3, 0.0, 1.0), ("c", 4, 0.0, 1.0)], "audio_id string, seg_id int, start_s double, end_s double")
    got = {r.seg_id: r for r in sound.per_segment(recordings, segs, sound.ProsodicFeatures).collect()}
    assert [got[i].prosody_status for i in (1, 2, 3, 4)] == ["ok", "too_short_audio", None, None] and got[1].pitch_mean == pytest.approx(200, rel=0.02)
    emotion = {r.seg_id: r for r in sound.per_segment(recordings, segs, sound.StandInEmotion).collect()}
    assert emotion[1].ser_pred_label == "enfado" and emotion[2].ser_pred_label is None and sum(emotion[1].ser_probabilities.values()) == pytest.approx(1)
    vectors = {r.seg_id: r.v for r in sound.per_segment(recordings, segs, sound.StandInVectors).collect()}
    assert np.linalg.norm(vectors[1]) == pytest.approx(1) and vectors[3] is None


def test_files_and_stages(spark, tmp_path):
    root = str(tmp_path)
    files.write_json_atomic(spark, {"a": "ñ"}, f"{root}/x.json")
    files.write_json_atomic(spark, {"a": 1}, f"{root}/x.json")
    assert (tmp_path / "x.json").read_text() == '{\n  "a": 1\n}' and not list(tmp_path.glob("*.part"))
    for n in ("raw_1_final_segments.csv", "all_final_segments.csv", "tmp_2_final_segments.csv"):
        (tmp_path / n).write_text("a\n1\n")
    got = {r.file_name: (r.audio_id, r.has_temp_prefix) for r in files.segment_files(spark, root).collect()}
    assert set(got) == {"raw_1_final_segments.csv", "tmp_2_final_segments.csv"} and got["tmp_2_final_segments.csv"][1] and "content" not in files.file_audit(spark, root).columns
    assert files.audio_paths("/r/", "9")["words"] == "/r/9_whisper_words.csv"
    calls = spark.createDataFrame([(1, 2.0, "x")], "audio_id long, score double, transcripcion string")
    stage = stages.StageSet("t", {"calls": ["audio_id", "score"]}, {"more": ["z"]}, ("transcripcion",))
    assert not stage.complete(spark, root)
    with pytest.raises(FileNotFoundError):
        stage.load(spark, root)
    first = stage.reused(spark, root, lambda: {"calls": calls})
    assert first["calls"].columns == ["audio_id", "score"] and stage.complete(spark, root)
    again = stage.reused(spark, root, lambda: pytest.fail("made twice"))
    assert set(again) == {"calls"}
    with pytest.raises(KeyError):
        stage.save(spark, root, {"other": calls})
    assert stages.pending(spark.range(3), spark.range(1), ["id"]).count() == 2


def test_a_set_is_stored_whole_or_not_at_all(spark, tmp_path):
    root = str(tmp_path)
    stage = stages.StageSet("t", {"a": ["x"], "b": ["x"]}, {"more": []})
    one, two = (spark.range(n).withColumn("x", F.lit(n)) for n in (1, 2))
    first = stage.save(spark, root, {"a": one, "b": one, "more": one})
    opened = stage.load(spark, root)
    dies = two.withColumn("x", F.raise_error(F.lit("out of order")).cast("int"))
    with pytest.raises(Exception, match="out of order"):
        stage.save(spark, root, {"a": two, "b": dies})
    assert stage.manifest(spark, root)["version"] == first and stage.complete(spark, root)
    assert {t: df.count() for t, df in stage.load(spark, root).items()} == {"a": 1, "b": 1, "more": 1}
    assert len(stage.swept(spark, root)) == 1 and stage.swept(spark, root) == []
    second = stage.save(spark, root, {"a": two, "b": two})
    assert {t: df.count() for t, df in stage.load(spark, root).items()} == {"a": 2, "b": 2}  # without the optional table of the older run
    assert opened["a"].count() == 1  # who has opened the old set still reads it
    third = stage.save(spark, root, {"a": one}, keep=True)
    assert stage.manifest(spark, root)["tables"] == {"a": third, "b": second} and stage.complete(spark, root)
    assert stage.swept(spark, root) == [first]


def test_an_incomplete_set_is_not_loaded(spark, tmp_path):
    root = str(tmp_path)
    stage = stages.StageSet("t", {"a": ["x"], "b": ["x"]})
    stage.save(spark, root, {"a": spark.range(3).withColumn("x", F.lit(1))})
    assert stage.manifest(spark, root)["missing"] == ["b"] and not stage.complete(spark, root)
    with pytest.raises(ValueError, match="incomplete"):
        stage.load(spark, root)
    assert set(stage.load(spark, root, partial=True)) == {"a"}
    made = stage.reused(spark, root, lambda: {t: spark.range(2).withColumn("x", F.lit(1)) for t in "ab"})
    assert set(made) == {"a", "b"} and stage.complete(spark, root)


def test_warehouse_union(spark, tmp_path):
    spark.createDataFrame([("raw_1.wav", "7.0", " ana ")], "audio_name string, customer string, agent string").write.parquet(f"{tmp_path}/a")
    spark.createDataFrame([("raw_bajas_2_clean.wav", "hola")], "audio_name string, transcripcion string").write.json(f"{tmp_path}/b")
    sources = [warehouse.Source("uno", f"{tmp_path}/a", "parquet"), warehouse.Source("dos", f"{tmp_path}/b", "json")]
    got = {r.source_dataset: r for r in warehouse.official_metadata(spark, sources, "s").collect()}
    assert got["uno"].customer == "7" and got["uno"].agent == "ana" and got["uno"].agent_hash and got["dos"].agent_hash is None
    assert got["dos"].has_official_transcription and not got["uno"].has_official_transcription and got["dos"].audio_id_base == "2"
    spark.createDataFrame([(1,)], "k int").createOrReplaceTempView("w1")
    assert warehouse.union_sources(spark, [warehouse.Source("v", "w1")]).first().source_table == "w1"


def test_serving_and_plane(spark):
    v = [(i, i % 2, [float(i % 2), 1.0 - i % 2, 0.1 * i]) for i in range(8)]
    df = spark.createDataFrame(v, "sample_id int, person_id int, v array<double>")
    stored = voiceprint.profiles(df)
    got = reports.served(df, stored, 0.5, 3).collect()
    assert len(got) == 8 and {r.decision for r in got} == {"KNOWN"}
    with pytest.raises(Exception, match="components"):
        reports.served(spark.createDataFrame([(1, 1, [1.0])], df.schema), stored, 0.5, 3).collect()
    flat = np.array([r.xy for r in reports.plane(df).collect()])
    assert flat.shape == (8, 2) and np.abs(flat.mean(0)).max() < 1e-9


def test_ranks_and_quantiles_against_numpy(spark):
    r = np.random.default_rng(3)
    x = np.concatenate((r.normal(size=300), -np.exp(r.normal(size=50) * 9), np.zeros(7), r.integers(-3, 4, 60).astype(float)))
    df = spark.createDataFrame([(float(v), i) for i, v in enumerate(x)] + [(None, -1)], "x double, i long").repartition(5)
    got = ranks.quantiles(df, {"x": [0.0, 0.01, 0.25, 0.5, 1.0]}, {("x", q): f"q{int(100 * q)}" for q in (0.0, 0.01, 0.25, 0.5, 1.0)}).first()
    for q in (0.0, 0.01, 0.25, 0.5, 1.0):
        assert got[f"q{int(100 * q)}"] == pytest.approx(np.quantile(x, q), rel=1e-9, abs=1e-12)
    average = {v: np.mean(np.flatnonzero(np.sort(x) == v)) + 1 for v in set(x.tolist())}
    assert {r_.x: r_.k for r_ in ranks.average_ranks(df, "x", "k").collect()} == pytest.approx(average)
    named = ranks.numbered(df.withColumn("g", F.col("i") % 5), ["g", "i"], "n").orderBy("n").collect()
    assert [r_.n for r_ in named] == list(range(len(x) + 1)) and [(r_.g, r_.i) for r_ in named] == sorted((r_.g, r_.i) for r_ in named)
    order = [r_.n for r_ in ranks.by_digest(df, F.sha2(F.col("i").cast("string"), 256), "i", "n", "all").collect()]
    assert sorted(order) == list(range(1, len(x) + 2))
