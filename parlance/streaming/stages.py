"""Model stages over a folder that grows: what is new is worked on once, and a run that dies goes on where it was."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.sources.files import folders, read_json, write_json_atomic

_FILE = "path string, modificationTime timestamp, length long, content binary"


def new_files(spark: SparkSession, path: str, glob: str = "*.[wW][aA][vV]", files_a_batch: int = 1000) -> DataFrame:
    """A stream of the files of a folder and those below it, with their content."""
    read = spark.readStream.format("binaryFile").schema(_FILE).option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    return read.option("maxFilesPerTrigger", files_a_batch).load(path)


def run_pending(spark: SparkSession, source: str, target: str, checkpoint: str, stage: Callable[[DataFrame], DataFrame], glob: str = "*.[wW][aA][vV]", files_a_batch: int = 1000) -> int:
    """Work on all files of ``source`` that no run has done, then stop; gives the number of batches.

    ``stage`` takes ``path, length, modificationTime, content`` and gives rows with ``path``; if they have ``error`` too,
    a recording with one is not done. The rows of a batch are a folder under ``target/rows`` named by the checkpoint and
    the batch, so that a batch that is run again replaces its own; they count once the batch's recordings
    stand in ``target/done``, which is written last. The checkpoint leaves out what was offered before. Without it (lost, or a
    new one to ask failed recordings again) those in ``target/done`` are left out, unless their size or time is another.
    """
    own = read_json(spark, f"{checkpoint}/stage.json")
    if own is None:
        own = {"run": uuid.uuid4().hex}
        write_json_atomic(spark, own, f"{checkpoint}/stage.json")
    batches = []

    def sink(batch: DataFrame, number: int) -> None:
        name = f"run={own['run']}/batch={number}"
        pending = batch
        known = _done(spark, target)
        if known is not None:  # the batch's own entry, of a run that died before its commit, is no reason to leave it out
            others = known.filter((F.col("run") != own["run"]) | (F.col("batch") != number)).filter("NOT failed").select("path", "length", "modificationTime")
            pending = batch.join(others, ["path", "length", "modificationTime"], "left_anti")
        rows = stage(pending)
        rows.write.mode("overwrite").parquet(f"{target}/rows/{name}")
        entries = pending.select("path", "length", "modificationTime")
        if "error" in rows.columns:
            bad = spark.read.schema(rows.schema).parquet(f"{target}/rows/{name}").filter("error IS NOT NULL").select("path").distinct().withColumn("failed", F.lit(True))
            entries = entries.join(bad, "path", "left").withColumn("failed", F.coalesce("failed", F.lit(False)))
        else:
            entries = entries.withColumn("failed", F.lit(False))
        entries.write.mode("overwrite").parquet(f"{target}/done/{name}")
        batches.append(number)

    query = new_files(spark, source, glob, files_a_batch).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return len(batches)


_DONE = "path string, length long, modificationTime timestamp, failed boolean, run string, batch long"


def _done(spark: SparkSession, target: str) -> DataFrame | None:
    """Entries of the batches that were written whole."""
    if not folders(spark, f"{target}/done"):
        return None
    return spark.read.schema(_DONE).option("basePath", f"{target}/done").parquet(f"{target}/done")


def results(spark: SparkSession, target: str, schema: str) -> DataFrame:
    """Rows (of ``schema``, which names ``path``) of each recording's last batch that did it; rows of halves and of failures that were mended are left out."""
    done = _done(spark, target)
    if done is None:
        return spark.createDataFrame([], schema)
    last = done.groupBy("path").agg(F.max_by(F.struct("run", "batch"), F.struct(~F.col("failed"), "modificationTime", "run", "batch")).alias("at")).select("path", "at.run", "at.batch")
    names = spark.createDataFrame([], schema).columns
    rows = spark.read.schema(f"{schema}, run string, batch long").option("basePath", f"{target}/rows").parquet(f"{target}/rows")
    return rows.join(last, ["path", "run", "batch"], "left_semi").select(*names)
