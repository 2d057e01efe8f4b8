import pytest
from pyspark.sql import functions as F

from parlance.operators import summaries


def test_vectors_wide_and_back(spark):
    df = spark.createDataFrame([(1, [0.5] * 20), (2, None)], "i int, v array<float>")
    wide = summaries.wide_vectors(df, "v", 20)
    assert wide.columns[:3] == ["i", "emb_0000", "emb_0001"] and wide.count() == 1
    assert summaries.narrow_vectors(wide).first().v == [0.5] * 20
    with pytest.raises(KeyError):
        summaries.narrow_vectors(wide.select("i", "emb_0000"))


def test_negative_probability_column():
    assert summaries.negative_probability(["x", "ser_prob_sad", "ser_prob_angry"]) == "ser_prob_angry"
    assert summaries.negative_probability(["ser_prob_calm", "ser_prob_fearful"]) == "ser_prob_fearful"
    assert summaries.negative_probability(["ser_prob_calm"]) is None


def test_signature_manifest_and_uri(spark):
    assert summaries.signature({"a": 1, "b": 2}) == summaries.signature({"b": 2, "a": 1})
    assert summaries.manifest({}, {"t": spark.range(2)})["status"] == "completed"
    assert summaries.manifest({}, {"t": spark.range(0)})["status"] == "incomplete"
    assert summaries.split_uri("s3://bucket/a/b/") == ("bucket", "a/b")
    with pytest.raises(ValueError):
        summaries.split_uri("nothing")


def test_interval_labels_and_empty_summary(spark):
    a, b = summaries.interval_labels(F.lit(61.25), F.lit(125.0))
    one = spark.range(1).select(a.alias("a"), b.alias("b")).first()
    assert (one.a, one.b) == ("01:01 - 02:05", "01:01.25 - 02:05.00")
    none = spark.createDataFrame([], "audio_id string, speaker string, start_s double, end_s double")
    assert summaries.recording_summary(none, none, ["audio_id"]).count() == 0
