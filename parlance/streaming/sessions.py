"""Adjacent segments merged as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merged_sessions(stream: DataFrame, keys: list[str], time: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each key: rows no further apart than ``gap``. Rows later than ``late`` are left out.

    Works on a stream (append mode, a session is given once the watermark has passed it) and on a table.
    """
    marked = stream.withWatermark(time, late)
    out = marked.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count("*").alias("n_rows"))
    return out.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_rows")
