"""Features and model outputs of the segments of recordings.

A provider turns the samples of one segment into values. A recording is decoded once for all its
segments, which come beside it as one array; models are loaded at a task's first batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.operators.providers import decoded, stand_in_vector

FEATURES = (
    "audio_samples", "audio_duration_calc", "peak_abs", "rms_audio_mean", "rms_audio_std", "rms_audio_dbfs", "energy_dynamic_range", "zcr_mean", "zcr_std", "spectral_centroid_mean", "spectral_centroid_std",
    "spectral_bandwidth_mean", "spectral_rolloff_mean", "voiced_ratio", "pitch_mean", "pitch_std", "pitch_median", "pitch_range_p90_p10",
)


class SegmentProvider(Protocol):
    """Samples of a segment to the values of ``schema`` (without keys); None for nothing."""

    schema: str

    def values(self, samples: np.ndarray, rate: int) -> tuple | None: ...


def cut(samples: np.ndarray, rate: int, start: float, end: float) -> np.ndarray:
    """Samples from ``start`` to ``end`` seconds, within the recording."""
    a = max(0.0, float(start))
    lo, hi = (min(max(int(round(t * rate)), 0), len(samples)) for t in (a, max(a, float(end))))
    return samples[lo:hi]


def _frames(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    padded = np.pad(x, size // 2)
    return np.lib.stride_tricks.sliding_window_view(padded, size)[::hop]


def pitches(x: np.ndarray, rate: int, size: int = 1024, hop: int = 256, low: float = 50.0, high: float = 500.0, least: float = 0.5) -> np.ndarray:
    """Pitch (Hz) of each frame by the highest peak of its normalised autocorrelation between two pitches; NaN where that is under ``least``."""
    frames = _frames(x.astype(np.float64), size, hop)
    frames = frames - frames.mean(1, keepdims=True)
    spectrum = np.fft.rfft(frames, 2 * size, axis=1)
    own = np.fft.irfft(np.abs(spectrum) ** 2, axis=1)[:, :size]
    lo, hi = max(int(rate / high), 1), min(int(rate / low), size - 1)
    energy = np.maximum(own[:, :1], 1e-12)
    part = own[:, lo : hi + 1] / energy
    best = part.argmax(1)  # later multiples of the period are lower, as fewer samples overlap
    height = np.take_along_axis(part, best[:, None], 1)[:, 0] * size / (size - lo - best)
    return np.where((height >= least) & (own[:, 0] > 1e-9), rate / (lo + best), np.nan)


def sound_features(samples: np.ndarray, rate: int, size: int = 1024, hop: int = 256) -> tuple[str, dict[str, float]]:
    """(status, features of :data:`FEATURES`): ok, too_short_audio (under 0.2 s) or silent_audio. Missing ones are left out.

    Frames are centred. Pitch comes of autocorrelation.
    """
    x = np.nan_to_num(np.asarray(samples, np.float64))
    out: dict[str, float] = {"audio_samples": float(len(x)), "audio_duration_calc": len(x) / rate}
    if len(x) < int(0.2 * rate):
        return "too_short_audio", out
    out["peak_abs"] = float(np.abs(x).max())
    if out["peak_abs"] <= 1e-6:
        return "silent_audio", out
    frames = _frames(x, size, hop)
    rms = np.maximum(np.sqrt(np.square(frames).mean(1)), 1e-12)
    zcr = (np.signbit(frames[:, 1:]) != np.signbit(frames[:, :-1])).mean(1)
    magnitude = np.abs(np.fft.rfft(frames * np.hanning(size + 1)[:-1], axis=1))
    pitch_of = np.fft.rfftfreq(size, 1 / rate)
    share = magnitude / np.maximum(magnitude.sum(1, keepdims=True), 1e-12)
    centroid = share @ pitch_of
    bandwidth = np.sqrt((share * np.square(pitch_of[None] - centroid[:, None])).sum(1))
    rolloff = pitch_of[(share.cumsum(1) >= 0.85 * share.sum(1, keepdims=True)).argmax(1)]
    spread = lambda v: float(np.percentile(v, 90) - np.percentile(v, 10))
    out |= {"rms_audio_mean": rms.mean(), "rms_audio_std": rms.std(), "rms_audio_dbfs": 20 * np.log10(rms.mean()), "energy_dynamic_range": spread(rms), "zcr_mean": zcr.mean(), "zcr_std": zcr.std()}
    out |= {"spectral_centroid_mean": centroid.mean(), "spectral_centroid_std": centroid.std(), "spectral_bandwidth_mean": bandwidth.mean(), "spectral_rolloff_mean": rolloff.mean()}
    f0 = pitches(x, rate, size, hop)
    out["voiced_ratio"] = float(np.isfinite(f0).mean())
    f0 = f0[np.isfinite(f0)]
    if len(f0):
        out |= {"pitch_mean": f0.mean(), "pitch_std": f0.std(), "pitch_median": np.median(f0), "pitch_range_p90_p10": spread(f0)}
    return "ok", {k: float(v) for k, v in out.items()}


class ProsodicFeatures:
    """The features of sound of each segment and their status."""

    schema = ", ".join(f"{f} double" for f in FEATURES) + ", prosody_status string"

    def values(self, samples: np.ndarray, rate: int) -> tuple:
        status, found = sound_features(samples, rate)
        return (*[found.get(f) for f in FEATURES], status)


class StandInVectors:
    """Stand-in speaker vectors: unit vectors that depend on the samples alone; none without samples."""

    schema = "v array<double>"

    def values(self, samples: np.ndarray, rate: int) -> tuple | None:
        return (stand_in_vector(samples.astype(np.float32).tobytes().hex()[:4096]).tolist(),) if len(samples) else None


class StandInEmotion:
    """Stand-in speech emotion: a label and a probability for each class by loudness; segments under half a second are skipped."""

    schema = "ser_pred_label string, ser_pred_score double, ser_probabilities map<string,double>"

    def values(self, samples: np.ndarray, rate: int) -> tuple | None:
        if len(samples) < rate / 2:
            return None
        loud = min(float(np.sqrt(np.mean(np.square(samples)))) * 2, 1.0)
        p = {"enfado": loud, "neutral": 1 - loud}
        label = max(p, key=lambda k: (p[k], k))
        return label, p[label], p


def per_segment(files: DataFrame, segments: DataFrame, make: Callable[[], SegmentProvider], audio_id: str = "audio_id", seg_id: str = "seg_id") -> DataFrame:
    """A provider's values of each segment: ``audio_id, seg_id`` and the provider's columns; null where it gives nothing.

    ``files`` has ``audio_id`` and ``content`` (WAV), ``segments`` times in seconds. Segments whose
    recording is missing or cannot be read have nulls as well.
    """
    schema = make().schema
    names = [f.strip().split()[0] for f in schema.replace("map<string,double>", "map").split(",")]
    kind = segments.schema[seg_id].dataType.simpleString()
    asked = segments.groupBy(audio_id).agg(F.collect_list(F.struct(F.col(seg_id).alias("seg"), F.col("start_s").alias("a"), F.col("end_s").alias("b"))).alias("asked"))  # of one recording
    both = asked.join(files.select(audio_id, "content"), audio_id, "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = None
        for pdf in batches:
            provider = provider or make()
            out = []
            for key, asked_, content in zip(pdf[audio_id], pdf["asked"], pdf["content"]):
                try:
                    samples, rate = decoded(content)
                except Exception:  # any broken file: its segments stay without values
                    samples, rate = None, 0
                for s in asked_:
                    got = provider.values(cut(samples, rate, s["a"], s["b"]), rate) if samples is not None else None
                    out.append((key, s["seg"], *(got or [None] * len(names))))
            yield pd.DataFrame(out, columns=[audio_id, seg_id, *names])

    return both.mapInPandas(run, f"{audio_id} {segments.schema[audio_id].dataType.simpleString()}, {seg_id} {kind}, {schema}")
