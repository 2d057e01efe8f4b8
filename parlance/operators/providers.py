"""Where models plug in: small interfaces, and deterministic stand-ins for tests.

A provider turns Arrow batches of one stage into batches of another. Models are loaded at a task's
first batch. Only these functions run Python on the executors.
"""

from __future__ import annotations

import hashlib
import io
import math
import struct
import wave
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

SEGMENT_SCHEMA = "audio_id string, seg_id int, start_s double, end_s double, speaker string"
WORD_SCHEMA = "audio_id string, word_id int, word string, w_start double, w_end double, prob double"
LABEL_SCHEMA = "label string, score double"


class RowsProvider(Protocol):
    """Rows of one recording to rows of a schema."""

    schema: str

    def rows(self, audio_id: str, samples: np.ndarray, rate: int) -> list[tuple]: ...


def decoded(content: bytes) -> tuple[np.ndarray, int]:
    """Mono samples in -1..1 and rate of a WAV file: PCM of 8, 16, 24 or 32 bits, or floats of 32 or 64."""
    floats = _float_samples(content)
    if floats is not None:
        return floats
    with wave.open(io.BytesIO(content)) as w:
        rate, channels, width = w.getframerate(), w.getnchannels(), w.getsampwidth()
        raw = w.readframes(w.getnframes())
    if width == 3:  # the three bytes are the upper ones of 32 bits
        wide = np.zeros((len(raw) // 3, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        raw, width = wide.tobytes(), 4
    kind = {1: np.uint8, 2: np.int16, 4: np.int32}[width]
    x = np.frombuffer(raw, kind).astype(np.float32)
    x = (x - 128) / 128 if width == 1 else x / float(2 ** (8 * width - 1))
    return x.reshape(-1, channels).mean(1), rate


def _float_samples(content: bytes) -> tuple[np.ndarray, int] | None:
    """Samples and rate of a WAV file of floats, also in the extensible format; None for other files, which :func:`decoded` reads or refuses."""
    if content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        return None
    at, form = 12, None
    while at + 8 <= len(content):
        name, size = struct.unpack_from("<4sI", content, at)
        body = content[at + 8 : at + 8 + size]
        if name == b"fmt " and len(body) >= 16:
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", body)
            kind = struct.unpack_from("<H", body, 24)[0] if kind == 0xFFFE and len(body) >= 26 else kind
            if kind != 3 or bits not in (32, 64) or not channels:
                return None
            form = (channels, rate, bits // 8)
        elif name == b"data" and form:
            channels, rate, width = form
            whole = len(body) // (width * channels) * width * channels
            x = np.frombuffer(body[:whole], f"<f{width}").reshape(-1, channels).mean(1)
            return np.nan_to_num(x, nan=0.0, posinf=1.0, neginf=-1.0).astype(np.float32), rate
        at += 8 + size + size % 2
    return None


@lru_cache(maxsize=8)
def _phases(up: int, down: int, zeros: int, rolloff: float, beta: float) -> np.ndarray:
    """A row of taps for each place of an output sample between two input samples: a sinc under a Kaiser window, with a sum of 1."""
    cut = min(1.0, up / down) * rolloff
    half = math.ceil(zeros / cut)
    away = np.arange(1 - half, half + 1)[None, :] - np.arange(up)[:, None] / up
    window = np.i0(beta * np.sqrt(np.clip(1 - (away / half) ** 2, 0, 1)))
    taps = np.sinc(cut * away) * window
    return (taps / taps.sum(1, keepdims=True)).astype(np.float32)


def resampled(x: np.ndarray, rate: int, target: int, zeros: int = 32, rolloff: float = 0.945, beta: float = 12.0) -> np.ndarray:
    """Samples at another rate, band-limited: what lies over half the lower rate goes, so nothing folds back.

    A polyphase filter: output samples at the same place between two input samples share their taps, ``zeros`` zero
    crossings on either side. The signal is silent beyond its ends. ``ceil(len(x) * target / rate)`` samples come out.
    """
    if rate == target or not len(x):
        return x
    if rate <= 0 or target <= 0:
        raise ValueError("rates must be positive")
    common = math.gcd(rate, target)
    up, down = target // common, rate // common
    taps = _phases(up, down, zeros, rolloff, beta)
    half = taps.shape[1] // 2
    views = np.lib.stride_tricks.sliding_window_view(np.pad(x.astype(np.float32, copy=False), (half - 1, half + 1)), 2 * half)
    out = np.empty(-(-len(x) * up // down), np.float32)
    for first in range(min(up, len(out))):
        base, phase = divmod(first * down, up)
        out[first::up] = views[base::down][: len(out[first::up])] @ taps[phase]
    return out


def at_rate(content: bytes, target: int | None) -> tuple[np.ndarray, int]:
    """:func:`decoded`, then :func:`resampled` where a rate is asked for."""
    x, rate = decoded(content)
    return (x, rate) if target is None else (resampled(x, rate, target), target)


def per_recording(files: DataFrame, make: Callable[[], RowsProvider], schema: str, rows: Callable[[RowsProvider, str, bytes], list[tuple]], errors: bool) -> DataFrame:
    """``rows`` of each file (``path``, ``content``) with a provider made once a task.

    With ``errors`` there are two columns more, ``path`` and ``error``, and a recording that fails gives one row of them alone; without, it ends the job.
    """
    names = [c.strip().split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = None
        for pdf in batches:
            provider = provider or make()
            out: list[tuple] = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    found = rows(provider, path, content)
                except Exception as e:  # noqa: BLE001
                    if not errors:
                        raise
                    out.append((*[None] * len(names), path, f"{type(e).__name__}: {e}"))
                else:
                    out += [(*r, path, None) for r in found] if errors else found
            yield pd.DataFrame(out, columns=[*names, "path", "error"] if errors else names, dtype=object)

    return files.select("path", "content").mapInPandas(run, f"{schema}, path string, error string" if errors else schema)


def applied(files: DataFrame, make: Callable[[], RowsProvider], schema: str, errors: bool = False, target_rate: int | None = None) -> DataFrame:
    """A provider's rows of each WAV file (``path``, ``content``), at ``target_rate`` if given. With ``errors`` unreadable files are rows of :func:`failures`."""
    return per_recording(files, make, schema, lambda p, path, content: p.rows(path.rsplit("/", 1)[-1], *at_rate(content, target_rate)), errors)


def failures(rows: DataFrame) -> DataFrame:
    """``path, error`` of the recordings that failed, of rows made with ``errors``."""
    return rows.filter("error IS NOT NULL").select("path", "error")


def rms_dbfs(x: np.ndarray, floor: float = -120.0) -> float:
    """Loudness of samples in dB of full scale, at least ``floor``."""
    power = float(np.mean(np.square(x, dtype=np.float64))) if len(x) else 0.0
    return max(10 * np.log10(power), floor) if power > 0 else floor


def silences(x: np.ndarray, rate: int, top_db: float = 30.0, frame: int = 2048, hop: int = 512) -> list[tuple[float, float]]:
    """Stretches (seconds) whose frames are more than ``top_db`` below the loudest frame."""
    if not len(x):
        return []
    padded = np.pad(x.astype(np.float64), frame // 2)
    total = np.concatenate(([0.0], np.cumsum(np.square(padded))))
    at = np.arange(0, len(padded) - frame + 1, hop)
    sums = total[at + frame] - total[at]
    quiet = 10 * np.log10(np.maximum(sums, 1e-20) / max(sums.max(), 1e-20)) < -top_db
    edges = np.flatnonzero(np.diff(np.concatenate(([0], quiet.astype(int), [0]))))
    return [(a * hop / rate, min(b * hop, len(x)) / rate) for a, b in zip(edges[::2], edges[1::2])]


def shortened(x: np.ndarray, rate: int, top_db: float = 30.0, keep: float = 0.3, most: float = 0.75) -> np.ndarray:
    """Samples with pauses over ``keep`` cut to at most ``most`` seconds of zeros."""
    parts, at = [], 0
    for a, b in silences(x, rate, top_db):
        lo, hi = int(a * rate), int(b * rate)
        if b - a <= keep:
            continue
        parts += [x[at:lo], np.zeros(min(hi - lo, int(most * rate)), x.dtype)]
        at = hi
    return np.concatenate([*parts, x[at:]])


class TurnsOfSeconds:
    """Stand-in diarization: the speakers take turns of a second."""

    schema = SEGMENT_SCHEMA

    def rows(self, audio_id: str, samples: np.ndarray, rate: int) -> list[tuple]:
        n = int(np.ceil(len(samples) / rate))
        return [(audio_id, i, float(i), min(i + 1.0, len(samples) / rate), f"SPEAKER_{i % 2:02d}") for i in range(n)]


class WordsOfHalfSeconds:
    """Stand-in transcription: a word each half second."""

    schema = WORD_SCHEMA

    def rows(self, audio_id: str, samples: np.ndarray, rate: int) -> list[tuple]:
        n = int(2 * len(samples) / rate)
        return [(audio_id, i, f"word{i}", i / 2, i / 2 + 0.4, 0.9) for i in range(n)]


def stand_in_vector(key: str, size: int = 16) -> np.ndarray:
    """A unit vector that only depends on the key."""
    seed = int.from_bytes(hashlib.sha256(key.encode()).digest()[:8], "little")
    v = np.random.default_rng(seed).normal(size=size)
    return v / np.linalg.norm(v)


def stand_in_sentiment(text: str) -> tuple[str, float]:
    """A label that only depends on the text's length."""
    n = len(text or "")
    return ("negative", "neutral", "positive")[n % 3], 0.5 + (n % 50) / 100
