"""Recordings as files."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions.names import recording_id

INVENTORY = "path string, audio_name string, size_bytes long, duration_seconds double, sample_rate int, n_channels int, error string"


def wav_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, modificationTime, length, content`` of all ``.wav`` files below a path, whatever their case."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.[wW][aA][vV]").option("recursiveFileLookup", "true").load(path)


def _headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for path, size, content in zip(pdf["path"], pdf["length"], pdf["content"]):
            name = path.rsplit("/", 1)[-1]
            try:
                with wave.open(io.BytesIO(content)) as w:
                    rows.append((path, name, size, w.getnframes() / w.getframerate(), w.getframerate(), w.getnchannels(), None))
            except (wave.Error, EOFError, ZeroDivisionError) as e:
                rows.append((path, name, size, None, None, None, str(e) or type(e).__name__))
        yield pd.DataFrame(rows, columns=[c.strip().split()[0] for c in INVENTORY.split(",")]).astype({"sample_rate": "Int32", "n_channels": "Int32"})


def inventory(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(readable recordings, unreadable ones with their error)."""
    rows = wav_files(spark, path).select("path", "length", "content").mapInPandas(_headers, INVENTORY).withColumn("audio_id", recording_id(F.col("audio_name")))
    return rows.filter("error IS NULL").drop("error"), rows.filter("error IS NOT NULL").select("path", "audio_name", "error")
