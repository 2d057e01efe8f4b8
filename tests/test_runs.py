"""Runs of model stages with stand-ins."""

import numpy as np
import pytest
from test_sources import wav

from parlance.operators import providers, runs


def quiet():
    """A provider that hears words only where it is loud; made within a function, so that workers need no import."""

    class Quiet:
        schema = providers.WORD_SCHEMA

        def rows(self, audio_id, samples, rate):
            return [(audio_id, 0, "hola", 0.0, 0.4, 0.9)] if float(np.abs(samples).max()) > 0.05 else []

    return Quiet


def by_length():
    class ByLength:
        def labels(self, texts):
            if any(t == "bad" for t in texts):
                raise RuntimeError("no memory")
            return [providers.stand_in_sentiment(t) for t in texts]

    return ByLength


def test_cleaning_report(spark):
    t = np.arange(8000 * 30) / 8000
    speech = 0.5 * np.sin(2 * np.pi * 200 * t)
    speech[8000 * 10 : 8000 * 25] = 0
    rows = [("a.wav", wav(speech)), ("b.wav", wav(np.zeros(8000))), ("c.wav", b"broken")]
    got = {r.path: r for r in runs.cleaning_report(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got["a.wav"].valid and got["a.wav"].removed_s == pytest.approx(14.25, abs=0.3) and got["a.wav"].clean_s == pytest.approx(15.75, abs=0.3)
    assert not got["b.wav"].valid and got["b.wav"].clean_s == 0 and got["c.wav"].error and got["c.wav"].valid is None


def test_retry_with_gain(spark):
    rows = [("x/soft.wav", wav(np.full(8000, 0.01))), ("x/none.wav", wav(np.zeros(8000)))]
    files = spark.createDataFrame(rows, "path string, content binary")
    one = runs.TranscriptionRun("small")
    assert [r.audio_id for r in runs.transcribed(files, quiet(), one).collect()] == ["soft.wav"]
    assert runs.transcribed(files, quiet(), runs.TranscriptionRun("small", retry_with_gain=False)).count() == 0
    assert one.run_id == runs.TranscriptionRun("small").run_id != runs.TranscriptionRun("large").run_id
    assert runs.with_gain(np.full(10, 0.5, np.float32))[1] < 1 and runs.with_gain(np.zeros(3))[1] == 1.0


def test_unreadable_recordings_become_rows(spark):
    rows = [("x/good.wav", wav(np.full(8000, 0.5))), ("x/bad.wav", b"broken"), ("x/none.wav", wav(np.zeros(8000)))]
    files = spark.createDataFrame(rows, "path string, content binary")
    for out in (runs.transcribed(files, quiet(), runs.TranscriptionRun("small"), errors=True), providers.applied(files, quiet(), providers.WORD_SCHEMA, errors=True)):
        assert [(r.path, r.error.split(":")[0][-5:]) for r in providers.failures(out).collect()] == [("x/bad.wav", "Error")]
        assert [(r.audio_id, r.path) for r in out.filter("error IS NULL").collect()] == [("good.wav", "x/good.wav")]
    with pytest.raises(Exception, match="RIFF|EOF|Error"):
        providers.applied(files, quiet(), providers.WORD_SCHEMA).collect()


def test_widths_of_samples():
    import io
    import wave

    x = np.array([0.0, 0.5, -0.5, 0.999, -1.0])
    for width, scale in ((2, 1 << 15), (3, 1 << 23), (4, 1 << 31)):
        raw = b"".join(int(np.clip(v * scale, -scale, scale - 1)).to_bytes(width, "little", signed=True) for v in x)
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(width)
            w.setframerate(8000)
            w.writeframes(raw)
        got, rate = providers.decoded(out.getvalue())
        assert rate == 8000 and np.allclose(got, x, atol=1e-3 if width == 2 else 1e-6)


def test_classified_keeps_failed_batches_pending(spark):
    df = spark.createDataFrame([(i, "bad" if i == 5 else "x" * i) for i in range(12)], "uid long, text string").coalesce(1)
    got = {r.uid: r.label for r in runs.classified(df, by_length(), "uid", batch=4).collect()}
    assert {k for k, v in got.items() if v is None} == {4, 5, 6, 7} and got[3] == "negative"
