"""Runs of the model stages: cleaned recordings, transcription with a retry, classification of what is pending."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from parlance.operators.providers import RowsProvider, at_rate, decoded, per_recording, rms_dbfs, shortened
from parlance.operators.summaries import signature

CLEANED = "path string, original_s double, clean_s double, removed_s double, removed_ratio double, rms_before double, rms_after double, valid boolean, error string"


@dataclass(frozen=True)
class TranscriptionRun:
    """What a run of transcription depends on; its id is a digest of that."""

    model_size: str
    language: str = "es"
    target_rate: int = 16_000
    tolerance_s: float = 0.4
    low_probability: float = 0.5
    retry_with_gain: bool = True
    target_retry_rms: float = 0.08
    most_gain: float = 10.0

    @property
    def run_id(self) -> str:
        return signature(asdict(self))


def cleaned(x: np.ndarray, rate: int, top_db: float = 30.0, keep: float = 0.3, most: float = 0.75, least_s: float = 10.0, most_removed: float = 0.9) -> tuple[np.ndarray, dict]:
    """Samples with long pauses cut, and what that did; valid if enough is left and not too much removed."""
    out = shortened(x, rate, top_db, keep, most) if len(x) and float(np.abs(x).max()) > 0 else x[:0]
    before, after = len(x) / rate, len(out) / rate
    ratio = (before - after) / before if before else 0.0
    facts = {"original_s": before, "clean_s": after, "removed_s": before - after, "removed_ratio": ratio, "rms_before": rms_dbfs(x), "rms_after": rms_dbfs(out)}
    return out, facts | {"valid": after >= least_s and ratio <= most_removed}


def cleaning_report(files: DataFrame) -> DataFrame:
    """One row for each WAV file (``path``, ``content``) by :func:`cleaned`; unreadable ones with their error."""
    names = [c.strip().split()[0] for c in CLEANED.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    out.append({"path": path, **cleaned(*decoded(content))[1], "error": None})
                except Exception as e:  # a broken file is a row, not the end of the run
                    out.append({"path": path, "error": str(e) or type(e).__name__})
            yield pd.DataFrame(out, columns=names)

    return files.select("path", "content").mapInPandas(run, CLEANED)


def with_gain(x: np.ndarray, target_rms: float = 0.08, most: float = 10.0) -> tuple[np.ndarray, float]:
    """Samples made louder up to a mean power, at most by ``most``, and the factor; silence stays."""
    rms = float(np.sqrt(np.mean(np.square(x, dtype=np.float64)))) if len(x) else 0.0
    if rms <= 1e-12:
        return x.copy(), 1.0
    gain = min(target_rms / rms, most)
    return np.clip(x * gain, -1, 1).astype(np.float32), gain


def transcribed(files: DataFrame, make: Callable[[], RowsProvider], run: TranscriptionRun, errors: bool = False) -> DataFrame:
    """A provider's rows of each recording, heard at the run's rate; one without any is tried again louder, where the run says so. ``errors`` as in ``providers.applied``."""

    def work(provider: RowsProvider, path: str, content: bytes) -> list[tuple]:
        samples, rate = at_rate(content, run.target_rate)
        name = path.rsplit("/", 1)[-1]
        rows = provider.rows(name, samples, rate)
        if not rows and run.retry_with_gain:
            rows = provider.rows(name, with_gain(samples, run.target_retry_rms, run.most_gain)[0], rate)
        return rows

    return per_recording(files, make, make().schema, work, errors)


class Classifier(Protocol):
    """Texts to (label, score) each."""

    def labels(self, texts: list[str]) -> list[tuple[str, float]]: ...


def classified(pending: DataFrame, make: Callable[[], Classifier], uid: str, text: str = "text", batch: int = 32) -> DataFrame:
    """``uid, label, score`` of each pending text; the texts of a batch that fails have nulls, so that they can be asked again."""
    kind = pending.schema[uid].dataType.simpleString()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for pdf in batches:
            model = model or make()
            out: list[tuple] = []
            for i in range(0, len(pdf), batch):
                part = pdf.iloc[i : i + batch]
                try:
                    got = model.labels([t or "" for t in part[text]])
                except Exception:  # the model's own failure: these stay pending
                    got = [(None, None)] * len(part)
                out += [(k, *g) for k, g in zip(part[uid], got)]
            yield pd.DataFrame(out, columns=[uid, "label", "score"])

    return pending.select(uid, text).mapInPandas(work, f"{uid} {kind}, label string, score double")
