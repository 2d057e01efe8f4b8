"""Summaries of recordings and runs, and the small tables behind reports."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.nulls import first_text, safe_rate
from parlance.functions.text import clock, clock_hundredths, salted_hash
from parlance.functions.vectors import cosine
from parlance.operators.ranks import with_medians


def recording_summary(segments: DataFrame, regions: DataFrame, keys: list[str], start: str = "start_s", end: str = "end_s") -> DataFrame:
    """For each recording: segments, speakers, last end, valid segments and anchors, overlap regions and their seconds."""
    flags = [F.sum(F.col(c).cast("long")).alias(f"n_{c}") for c in ("valid_export", "valid_anchor") if c in segments.columns]
    base = segments.groupBy(*keys).agg(F.count("*").alias("n_segments"), F.count_distinct("speaker").alias("n_speakers"), F.max(end).alias("last_s"), *flags)
    over = regions.groupBy(*keys).agg(F.count("*").alias("n_regions"), F.sum(F.col(end) - F.col(start)).alias("region_s"))
    return base.join(over, keys, "left").fillna({"n_regions": 0, "region_s": 0.0})


def quality_table(summary: DataFrame) -> DataFrame:
    """Shares of valid segments and of anchors among the scored ones; unknown without any."""
    return summary.withColumn("valid_share", safe_rate(F.col("n_valid_export"), F.col("n_segments"))).withColumn("anchor_share", safe_rate(F.col("n_valid_anchor"), F.col("n_segments")))


def speakers_per_recording(segments: DataFrame, keys: list[str]) -> DataFrame:
    """How many recordings have each number of speakers, and their share."""
    per = segments.groupBy(*keys).agg(F.count_distinct("speaker").alias("n_speakers"))
    counts = per.groupBy("n_speakers").agg(F.count("*").alias("n"))
    total = per.agg(F.count("*").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("n_speakers", "n", safe_rate(F.col("n"), F.col("total")).alias("share"))


def silence_summary(ratios: DataFrame, ratio: str = "silence_ratio", level: str = "top_db", high: float = 0.6) -> DataFrame:
    """For each level of the silence threshold: mean, median, deviation and extremes of the ratio, and recordings over ``high``."""
    r = F.col(ratio)
    facts = ratios.groupBy(level).agg(
        F.count(r).alias("n"), F.avg(r).alias("mean"), F.stddev_samp(r).alias("std"), F.min(r).alias("min"), F.max(r).alias("max"), F.sum((r > high).cast("long")).alias("n_high")
    )
    return with_medians(facts, ratios, {ratio: "median"}, [level])


def speaker_similarity(centroids: DataFrame, key: str, vector: str = "centroid") -> DataFrame:
    """Largest cosine between speakers of two recordings that share a group: ``a, b, similarity``.

    ``centroids``: ``group, key, centroid``. Pairs are formed within a group only.
    """
    a = centroids.select("group", F.col(key).alias("a"), F.col(vector).alias("va"))
    b = centroids.select("group", F.col(key).alias("b"), F.col(vector).alias("vb"))
    return a.join(b, "group").filter("a < b").groupBy("a", "b").agg(F.max(cosine(F.col("va"), F.col("vb"))).alias("similarity"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Rows in each of equal bins of [low, high); bin 0 and bins + 1 hold what lies outside."""
    return df.filter(F.col(value).isNotNull()).groupBy(F.width_bucket(F.col(value).cast("double"), F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))


def metadata(df: DataFrame, salt: str, hashed: dict[str, str], text: list[str]) -> DataFrame:
    """Metadata with trimmed texts without a trailing ``.0`` and salted hashes of identities; missing stays missing."""
    out = df.withColumns({c: F.regexp_replace(first_text(F.col(c)), "\\.0$", "") for c in text})
    return out.withColumns({into: salted_hash(F.col(c), salt) for c, into in hashed.items()})


def corpus_of(c: Column) -> Column:
    """The corpus that a name tells: Bajas, Comerciales or No identificado."""
    t = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    sales = t.rlike("comercial|venta") | t.startswith("raw_") | t.isin("raw", "general")
    return F.when(F.contains(t, F.lit("baja")), "Bajas").when(sales, "Comerciales").otherwise("No identificado")


def interval_labels(start: Column, end: Column) -> tuple[Column, Column]:
    """``MM:SS - MM:SS`` and the same with hundredths."""
    return F.concat(clock(start), F.lit(" - "), clock(end)), F.concat(clock_hundredths(start), F.lit(" - "), clock_hundredths(end))


#: Terms of anger, then of any negative emotion, in names of probability columns.
ANGER_TERMS = ("enfado", "anger", "angry", "ira", "rabia")
NEGATIVE_TERMS = ("enfado", "enojo", "ira", "anger", "angry", "rabia", "tristeza", "sad", "disgust", "asco", "miedo", "fear", "frustrac", "negative", "negativo")


def negative_probability(columns: list[str], prefix: str = "ser_prob_") -> str | None:
    """The first probability column named after anger, else after a negative emotion; terms are found within names."""
    mine = [c for c in columns if c.startswith(prefix)]
    for terms in (ANGER_TERMS, NEGATIVE_TERMS):
        found = next((c for c in mine if any(t in c.lower() for t in terms)), None)
        if found:
            return found
    return None


def wide_vectors(df: DataFrame, vector: str, size: int, prefix: str = "emb_") -> DataFrame:
    """A vector column as one column for each component; rows without a vector are left out."""
    rest = [c for c in df.columns if c != vector]
    return df.filter(F.col(vector).isNotNull()).select(*rest, *[F.get(vector, F.lit(i)).cast("float").alias(f"{prefix}{i:04d}") for i in range(size)])


def narrow_vectors(df: DataFrame, prefix: str = "emb_", into: str = "v", least: int = 16) -> DataFrame:
    """The reverse, of the columns with a prefix in their order; at least ``least`` are needed."""
    parts = sorted(c for c in df.columns if c.startswith(prefix))
    if len(parts) < least:
        raise KeyError(f"fewer than {least} columns begin with {prefix}")
    return df.select(*[c for c in df.columns if c not in parts], F.array(*parts).alias(into))


def signature(config: dict, size: int = 12) -> str:
    """Digest of a configuration, whatever the order of its keys."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:size]


def manifest(config: dict, tables: dict[str, DataFrame]) -> dict:
    """Signature, row counts and whether every table has rows."""
    rows = {n: t.count() for n, t in sorted(tables.items())}
    return {"signature": signature(config), "rows": rows, "status": "completed" if rows and all(rows.values()) else "incomplete"}


def split_uri(uri: str) -> tuple[str, str]:
    """(bucket, prefix) of ``scheme://bucket/prefix``."""
    scheme, sep, rest = uri.partition("://")
    if not sep or not scheme or not rest.partition("/")[0]:
        raise ValueError(f"no bucket in {uri!r}")
    bucket, _, prefix = rest.partition("/")
    return bucket, prefix.strip("/")
