"""Views of the bundled tables as recordings, and the same views in SQL.

The tables are a warehouse's and a corpus's; these views give them the shape of segments,
transcripts, vectors and call metadata. Times come of whole microseconds, so that both engines divide
the same numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions.text import count_words


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as speech segments of their user's recording."""
    e = table(spark, sf_dir, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    speaker = F.when(F.col("event_type").isin("click", "view", "signup"), "SPEAKER_00").otherwise("SPEAKER_01")
    s = e.select(F.col("user_id").alias("audio_id"), F.col("event_id").alias("seg_id"), (micros.cast("double") / 1e6).alias("start_s"), F.col("value"), speaker.alias("speaker"), (-F.col("value")).alias("rms"), "event_type")
    return s.withColumn("end_s", F.col("start_s") + F.col("value") * 600)


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as transcribed segments; users are clients, assistants agents, others nobody."""
    c = table(spark, sf_dir, "conversations")
    role = F.when(F.col("role") == "user", "CLIENT").when(F.col("role") == "assistant", "AGENT")
    t = c.select(F.col("conv_id").alias("audio_id"), F.col("turn").alias("seg_id"), (F.col("turn") * 10).cast("double").alias("start_s"), F.col("role").alias("speaker"), role.alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("n_words", count_words(F.col("text")).cast("long"))
    kind = F.length("text") % 3
    label = F.when(kind == 0, "negative").when(kind == 1, "neutral").otherwise("positive")
    return t.withColumn("end_s", F.col("start_s") + (2 * F.col("n_words")).cast("double") / 5).withColumn("label", label).withColumn("value", (kind - 1).cast("double"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as speaker vectors: the label is the person, fifty recordings."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("label").alias("person_id"), F.col("vec_id").alias("sample_id"), (F.col("vec_id") % 50).alias("audio_key"), F.col("embedding").alias("v"), (F.col("vec_id") % 7 + 1).cast("double").alias("seconds"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a score: words of the text's letters, for curves and thresholds."""
    d, lab = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    return d.join(lab, "doc_id").select("doc_id", F.col("quality").alias("y"), (count_words(F.col("text")) % 97).cast("double").alias("s"))


SEG = """seg AS (SELECT *, start_s + value * CAST(600 AS DOUBLE) AS end_s FROM (SELECT user_id AS audio_id, event_id AS seg_id,
  CAST(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS DOUBLE) / CAST(1000000 AS DOUBLE) AS start_s, value,
  CASE WHEN event_type IN ('click', 'view', 'signup') THEN 'SPEAKER_00' ELSE 'SPEAKER_01' END AS speaker, -value AS rms, event_type FROM events))"""

_WORDS = r"""CASE WHEN trim(regexp_replace({0}, '\s+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace({0}, '\s+', ' ', 'g')), ' ')) END"""


def words_sql(text: str) -> str:
    return _WORDS.format(text)


TXT = f"""txt AS (SELECT *, start_s + CAST(2 * n_words AS DOUBLE) / CAST(5 AS DOUBLE) AS end_s, CASE length(text) % 3 WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral' ELSE 'positive' END AS label,
  CAST(length(text) % 3 - 1 AS DOUBLE) AS value FROM (SELECT conv_id AS audio_id, turn AS seg_id, CAST(turn * 10 AS DOUBLE) AS start_s, role AS speaker,
  CASE role WHEN 'user' THEN 'CLIENT' WHEN 'assistant' THEN 'AGENT' END AS role, coalesce(text, '') AS text, CAST({words_sql("coalesce(text, '')")} AS BIGINT) AS n_words FROM conversations))"""

VEC = """vec AS (SELECT label AS person_id, vec_id AS sample_id, vec_id % 50 AS audio_key, CAST(embedding AS DOUBLE[]) AS v, CAST(vec_id % 7 + 1 AS DOUBLE) AS seconds FROM embeddings)"""

DOC = f"""doc AS (SELECT doc_id, quality AS y, CAST(({words_sql("coalesce(text, '')")}) % 97 AS DOUBLE) AS s FROM documents JOIN labels USING (doc_id))"""


def normal_sql(text: str) -> str:
    """The normalised text of ``functions.text.normalize_text``."""
    return rf"trim(regexp_replace(regexp_replace(strip_accents(lower(coalesce({text}, ''))), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def tokens_sql(text: str, stop: tuple[str, ...]) -> str:
    """The distinct match tokens of ``functions.text.match_tokens``."""
    words = rf"string_split(trim(regexp_replace(regexp_replace(strip_accents(lower(coalesce({text}, ''))), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')), ' ')"
    return f"list_distinct(list_filter({words}, lambda w: w <> '' AND NOT list_contains({list(stop)!r}, w)))"
