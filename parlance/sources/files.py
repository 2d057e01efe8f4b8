"""Files beside tables: small texts written whole, and catalogues of files without reading them."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions.names import consolidation_id


def write_text_atomic(spark: SparkSession, text: str, path: str, encoding: str = "utf-8") -> None:
    """Write a text under another name in the same folder and rename it over the target, on any file system of the session.

    Whoever reads meanwhile, or after a crash, finds the old text or the new one.
    """
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    part = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.part")
    out = fs.create(part, True)
    try:
        out.write(bytearray(text.encode(encoding)))
    finally:
        out.close()
    over = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    over[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(part, target, over)


def read_json(spark: SparkSession, path: str):
    """The data of a JSON file; None if it is not there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder; none if it is not there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()) if fs.exists(at) else []


def delete_folder(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def write_json_atomic(spark: SparkSession, data, path: str) -> None:
    write_text_atomic(spark, json.dumps(data, ensure_ascii=False, indent=2, default=str), path)


def file_audit(spark: SparkSession, path: str, glob: str = "*.csv", temp_prefix: str = "tmp") -> DataFrame:
    """``path, file_name, modificationTime, length, audio_id, has_temp_prefix`` of the files; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).drop("content")
    name = F.regexp_extract("path", "([^/]*)$", 1)
    return files.withColumn("file_name", name).withColumn("audio_id", consolidation_id(F.col("path"))).withColumn("has_temp_prefix", F.startswith(F.col("file_name"), F.lit(temp_prefix)))


def segment_files(spark: SparkSession, path: str, glob: str = "*_final_segments.csv", leave_out: tuple[str, ...] = ("all_final_segments.csv",)) -> DataFrame:
    """The segment tables of single recordings: files of the glob but for those over all recordings."""
    return file_audit(spark, path, glob).filter(~F.col("file_name").isin(*leave_out))


def audio_paths(root: str, audio_id: str) -> dict[str, str]:
    """Where the parts of one recording's transcription lie."""
    base = f"{root.rstrip('/')}/{audio_id}"
    return {"segments": f"{base}_transcribed_segments.csv", "words": f"{base}_whisper_words.csv", "asr": f"{base}_whisper_asr_segments.csv", "text": f"{base}.txt", "meta": f"{base}.json"}
