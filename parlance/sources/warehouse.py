"""Metadata of several warehouse tables as one, in whatever format they are."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions.names import plain_name, recording_id
from parlance.functions.text import salted_hash


@dataclass(frozen=True)
class Source:
    """A table: by name in the catalog, by path in a format, or by a reader's options (``jdbc``)."""

    name: str
    table: str
    fmt: str | None = None
    options: dict[str, str] = field(default_factory=dict)

    def read(self, spark: SparkSession) -> DataFrame:
        if self.fmt is None:
            return spark.table(self.table)
        reader = spark.read.format(self.fmt).options(**self.options)
        return reader.option("dbtable", self.table).load() if self.fmt == "jdbc" else reader.load(self.table)


def union_sources(spark: SparkSession, sources: list[Source]) -> DataFrame:
    """All rows of the sources by column name, missing columns null, with ``source_dataset`` and ``source_table``."""
    out = None
    for s in sources:
        df = s.read(spark).withColumn("source_dataset", F.lit(s.name)).withColumn("source_table", F.lit(s.table))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no sources")
    return out


#: Columns that official metadata may lack.
OPTIONAL = ("audio_name", "agent", "customer", "brand_ds", "channel", "call_date", "duration_min", "transcripcion", "resumen", "tipologia", "subtipologia", "resultado")


def official_metadata(spark: SparkSession, sources: list[Source], salt: str, name: str = "audio_name", hashed: dict[str, str] | None = None, text: str = "transcripcion") -> DataFrame:
    """The union with optional columns padded, texts trimmed and without a trailing ``.0``, ids of recordings and salted hashes.

    Gives also ``audio_id`` (the plain file name), ``audio_id_base`` and ``has_official_transcription``.
    """
    out = union_sources(spark, sources)
    for c in OPTIONAL:
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("string"))
    for c, t in out.dtypes:
        if t == "string":
            out = out.withColumn(c, F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), "\\.0$", ""))
    out = out.withColumn("audio_id", plain_name(F.col(name))).withColumn("audio_id_base", recording_id(F.col(name)))
    pairs = hashed or {"agent": "agent_hash", "customer": "customer_hash", "audio_id": "audio_hash"}
    out = out.withColumns({into: F.when(F.col(c) != "", salted_hash(F.col(c), salt)) for c, into in pairs.items()})
    return out.withColumn("has_official_transcription", F.col(text) != "")
