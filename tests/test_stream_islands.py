"""Islands on a stream against the same rows as a table."""

import random

from pyspark.sql import functions as F

from parlance.operators import intervals
from parlance.streaming.islands import merged_islands

SCHEMA = "audio_id string, seg_id long, speaker string, start_s double, end_s double"


def test_stream_equals_table_on_shuffled_input(spark, tmp_path):
    """Rows come in files out of order, within the lateness; a last row far ahead moves the watermark past all."""
    r = random.Random(5)
    rows, clock = [], {"x": 0.0, "y": 0.0, "z": 0.0}
    for i in range(300):
        k = r.choice("xyz")
        clock[k] += r.choice([0.0, 0.25, 0.75, 3.0, 40.0])
        rows.append((k, i, r.choice(["A", "A", "A", "B", None]), clock[k], clock[k] + r.choice([0.0, 0.5, 2.0, 9.0])))
    rows.sort(key=lambda x: x[3] + r.uniform(0, 90))
    parts = [rows[i : i + 60] for i in range(0, len(rows), 60)] + [[("end", 1_000 + j, "A", 1e5 * (j + 1), 1e5 * (j + 1))] for j in range(2)]
    folder = str(tmp_path / "in")
    for i, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{folder}/n{i:02d}")
        if i not in (2, len(parts) - 1):
            continue  # two runs: the second goes on from the state of the first
        source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)
        out = merged_islands(source.withColumn("event_time", F.timestamp_seconds("start_s")), late="30 minutes")
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    names = ["audio_id", "speaker", "seg_id", "start_s", "end_s", "n_merged"]
    got = sorted(map(str, (tuple(x) for x in spark.read.parquet(str(tmp_path / "out")).filter("audio_id <> 'end'").select(*names).collect())))
    table = intervals.merge_adjacent(spark.createDataFrame(rows, SCHEMA), max_gap=0.5).select(*names)
    assert got == sorted(map(str, (tuple(x) for x in table.collect()))) and len(got) > 100


def test_rows_too_late_and_without_times_are_left_out(spark, tmp_path):
    folder = str(tmp_path / "in")
    parts = [
        [("x", 1, "A", 100.0, 101.0), ("x", 2, "A", None, 5.0), ("x", 3, "A", 101.2, None), ("x", 4, "A", float("nan"), 5.0)],
        [("w", 5, "A", 9_000.0, 9_001.0)],  # moves the watermark to 8,940
        [("x", 6, "A", 101.5, 102.0), ("w", 7, "A", 9_001.2, 9_002.0)],
        [("w", 8, "A", 99_000.0, 99_000.0)], [("w", 9, "A", 199_000.0, 199_000.0)], [("w", 10, "A", 299_000.0, 299_000.0)],  # a batch sees the watermark of the batch before
    ]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{folder}/n{i}")
        source = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(folder)
        timed = source.withColumn("event_time", F.expr("CASE WHEN NOT isnan(start_s) THEN timestamp_seconds(start_s) END"))
        merged_islands(timed, late="1 minute").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = {(r.audio_id, r.seg_id): (r.end_s, r.n_merged) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("x", 1): (101.0, 1), ("w", 5): (9_002.0, 2), ("w", 8): (99_000.0, 1)}
