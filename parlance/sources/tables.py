"""Tables in and out: tolerant CSV at the edges, Parquet within."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_csv_or_empty(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A CSV with a header under an explicit schema; an empty table if it is missing."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.option("header", True).option("mode", "PERMISSIVE").schema(schema).csv(path)


def usable(spark: SparkSession, path: str, required: list[str], fmt: str = "parquet") -> bool:
    """Whether a table is there and has the columns; no rows are read."""
    try:
        reader = spark.read.format(fmt)
        return set(required) <= set((reader.option("header", True) if fmt == "csv" else reader).load(path).columns)
    except AnalysisException:
        return False


def write_table(df: DataFrame, path: str, columns: list[str] | None = None, fmt: str = "parquet", drop: tuple[str, ...] = ()) -> None:
    """``columns`` first (missing ones as nulls), the others after; private ones dropped. The commit protocol makes it whole."""
    first = columns or []
    padded = df.drop(*drop)
    for c in first:
        if c not in padded.columns:
            padded = padded.withColumn(c, F.lit(None).cast("string"))
    out = padded.select(*first, *[c for c in padded.columns if c not in first])
    writer = out.write.mode("overwrite")
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def stage(spark: SparkSession, path: str, make, required: list[str], force: bool = False) -> DataFrame:
    """The stored result of a stage if it is usable, else made, stored and read."""
    if force or not usable(spark, path, required):
        write_table(make(), path)
    return spark.read.parquet(path)


def union_tables(spark: SparkSession, paths: dict[str, str], tag: str = "source_dataset") -> DataFrame:
    """Tables of several sources under one another by name, each tagged; missing columns are null."""
    out = None
    for name, path in sorted(paths.items()):
        df = spark.read.parquet(path).withColumn(tag, F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no tables")
    return out


def with_file_name(df: DataFrame, into: str = "file_name") -> DataFrame:
    return df.withColumn(into, F.col("_metadata.file_name"))


def rttm(segments: DataFrame) -> DataFrame:
    """Speaker turns as RTTM lines (``value``), ready for a text sink."""
    line = F.format_string("SPEAKER %s 1 %.3f %.3f <NA> <NA> %s <NA> <NA>", F.col("audio_id").cast("string"), F.col("start_s"), F.col("end_s") - F.col("start_s"), F.col("speaker"))
    return segments.select(line.alias("value"))
