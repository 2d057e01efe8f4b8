"""Stages over a growing folder, and rates of recordings."""

import struct

import numpy as np
import pytest
from test_sources import wav

from parlance.operators import providers, runs
from parlance.streaming import stages

ROWS = f"{providers.WORD_SCHEMA}, path string, error string"


def loud():
    class Loud:
        schema = providers.WORD_SCHEMA

        def rows(self, audio_id, samples, rate):
            return [(audio_id, i, "hola", i * 1.0, i + 0.4, 0.9) for i in range(2)]

    return Loud


def heard(spark, target):
    return sorted((r.audio_id or "", r.word_id or 0, r.error is not None) for r in stages.results(spark, target, ROWS).collect())


def test_pending_recordings_are_done_once(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    asked = []

    def stage(files):
        asked.extend(r.path.rsplit("/", 1)[-1] for r in files.select("path").collect())
        return runs.transcribed(files, loud(), runs.TranscriptionRun("small"), errors=True)

    def put(name, content=None):
        (tmp_path / "in" / name).write_bytes(content or wav(np.full(8000, 0.5)))

    def dies(files):
        stage(files)
        raise RuntimeError("killed")

    go = lambda f, state=checkpoint: stages.run_pending(spark, source, target, state, f, files_a_batch=1)
    assert heard(spark, target) == []
    put("a.wav"), put("b.WAV"), put("c.wav", b"broken")
    with pytest.raises(Exception, match="killed"):
        go(dies)
    assert heard(spark, target) == []  # nothing of the batch that died
    assert go(stage) == 3
    both = [("a.wav", 0, False), ("a.wav", 1, False), ("b.WAV", 0, False), ("b.WAV", 1, False)]
    assert [r for r in heard(spark, target) if r[0]] == both and len(heard(spark, target)) == 5
    asked.clear()
    assert go(stage) == 0 and not asked  # a second run over the same folder does nothing
    put("d.wav")
    assert go(stage) == 1 and asked == ["d.wav"]
    asked.clear()
    put("c.wav")  # mended; a new checkpoint asks what failed or changed, and nothing else
    go(stage, str(tmp_path / "state2"))
    assert asked == ["c.wav"]
    done = [(n, i, False) for n in ("a.wav", "b.WAV", "c.wav", "d.wav") for i in (0, 1)]
    assert heard(spark, target) == done


def test_a_batch_whose_commit_was_lost_is_replaced(spark, tmp_path):
    """The batch wrote rows and entries, and the run died before the stream's commit: it runs again in full, once in the result."""
    source, target, state = tmp_path / "in", str(tmp_path / "out"), tmp_path / "state"
    source.mkdir()
    (source / "a.wav").write_bytes(wav(np.full(8000, 0.5)))
    stage = lambda files: runs.transcribed(files, loud(), runs.TranscriptionRun("small"), errors=True)
    assert stages.run_pending(spark, str(source), target, str(state), stage) == 1
    for f in (state / "commits").iterdir():
        f.unlink()
    assert stages.run_pending(spark, str(source), target, str(state), stage) == 1
    assert len(heard(spark, target)) == 2


def tone(hz, rate, s=1.0):
    return np.sin(2 * np.pi * hz * np.arange(int(rate * s)) / rate).astype(np.float32)


@pytest.mark.parametrize("rate,target", [(44_100, 16_000), (48_000, 16_000), (8_000, 16_000), (22_050, 16_000), (16_000, 8_000)])
def test_resampling_keeps_the_band_and_no_more(rate, target):
    n = -(-rate * target // rate)
    inner = slice(target // 20, n - target // 20)
    kept = min(rate, target) * 0.4
    got = providers.resampled(tone(kept, rate), rate, target)
    assert len(got) == n and np.abs(got[inner] - tone(kept, target)[inner]).max() < 2e-3
    if rate > target:  # what would fold back is gone: 70 dB down at a tenth over half the lower rate
        gone = providers.resampled(tone(target * 0.55, rate), rate, target)
        assert np.abs(gone[inner]).max() < 10 ** (-70 / 20)
    level = providers.resampled(np.full(rate, 0.25, np.float32), rate, target)
    assert np.allclose(level[inner], 0.25, atol=1e-4)


def test_resampling_against_the_sum_itself():
    """Each output is the windowed sum at its own time; odd rates, short and empty signals."""
    x = np.random.default_rng(1).normal(size=50).astype(np.float32)
    rate, target, zeros, rolloff, beta = 7, 5, 4, 0.9, 8.0
    got = providers.resampled(x, rate, target, zeros, rolloff, beta)
    cut = target / rate * rolloff
    half = int(np.ceil(zeros / cut))
    for k, y in enumerate(got):
        t = k * rate / target
        at = np.arange(int(np.floor(t)) + 1 - half, int(np.floor(t)) + half + 1)
        w = np.sinc(cut * (at - t)) * np.i0(beta * np.sqrt(np.clip(1 - ((at - t) / half) ** 2, 0, 1)))
        own = np.array([x[i] if 0 <= i < len(x) else 0.0 for i in at])
        assert abs((w / w.sum()) @ own - y) < 1e-5
    assert len(providers.resampled(x[:0], 7, 5)) == 0 and len(providers.resampled(x[:1], 44_100, 16_000)) == 1 and providers.resampled(x, 5, 5) is x


@pytest.mark.parametrize("kind,bits", [("<f4", 32), ("<f8", 64)])
@pytest.mark.parametrize("extensible", [False, True])
def test_float_recordings(kind, bits, extensible):
    x = np.array([[0.0, 0.5], [-1.0, 1.0], [0.25, 0.25]])
    head = struct.pack("<HHIIHH", 0xFFFE if extensible else 3, 2, 8000, 8000 * bits // 4, bits // 4, bits)
    head += struct.pack("<HHIH14s", 22, bits, 3, 3, b"") if extensible else b""
    body = b"LIST" + struct.pack("<I", 3) + b"abc\0" + b"fmt " + struct.pack("<I", len(head)) + head + b"data" + struct.pack("<I", x.size * bits // 8) + x.astype(kind).tobytes()
    got, rate = providers.decoded(b"RIFF" + struct.pack("<I", len(body) + 4) + b"WAVE" + body)
    assert rate == 8000 and np.allclose(got, [0.25, 0.0, 0.25])


def test_providers_hear_the_rate_of_the_run(spark):
    def make():
        class Rate:
            schema = "audio_id string, rate int, n int"

            def rows(self, audio_id, samples, rate):
                return [(audio_id, rate, len(samples))]

        return Rate()

    files = spark.createDataFrame([("x/a.wav", wav(np.full(8000, 0.5)))], "path string, content binary")
    assert [tuple(r) for r in runs.transcribed(files, make, runs.TranscriptionRun("small")).collect()] == [("a.wav", 16_000, 16_000)]
    assert [tuple(r) for r in providers.applied(files, make, "audio_id string, rate int, n int").collect()] == [("a.wav", 8_000, 8_000)]
