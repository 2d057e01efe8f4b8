"""The ``opN_`` queries: each applies one operator to its whole table and returns the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import ann, divergence, fill_middle, langid, license_scan, ngram_join, packing, pii, piece_lattice, pivot_index, quality, repeats, url_filter


def tokenizer_file(name: str) -> str:
    """Where a public vocabulary lies; the files come with the environment."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Stands for a secret of the installation; the queries have to repeat, so it is fixed here.
PSEUDONYM_KEY = "an example key, not a secret"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents")).drop("hits")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"))


def op3_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of each document, with digests of their ids and whether they decode to the text."""
    model = tokenizer_file("piece_bpe_32k.model")
    drawn = piece_lattice.encode(_table(spark, sf_dir, "documents"), model, carry_text=False, verify=True)
    ids = (F.octet_length("ids") / 4).cast("long")
    return drawn.select("doc_id", "draw", ids.alias("n_ids"), F.crc32("ids").alias("ids_crc32"), "log_prob", "perturbed", "inclusion", "round_trip")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judged(docs, carry=["doc_id"])


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_table(spark, sf_dir, "documents"), PSEUDONYM_KEY)


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removal_report(_table(spark, sf_dir, "documents"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(_table(spark, sf_dir, "embeddings"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "n_links", "n_copies", "n_words", "text_id")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audited(_table(spark, sf_dir, "documents"))


def op12_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_index.linked(_table(spark, sf_dir, "embeddings"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the outputs and of the texts rebuilt from them; ``fill_middle.transformed`` gives the outputs as well."""
    return fill_middle.transformed(_table(spark, sf_dir, "documents"), carry_output=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scans": op1_license_scans,
    "op2_url_filters": op2_url_filters,
    "op3_sentencepiece_sampling": op3_sentencepiece_sampling,
    "op4_quality_rules": op4_quality_rules,
    "op5_language_id": op5_language_id,
    "op6_pii": op6_pii,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_nearest_neighbours": op8_nearest_neighbours,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_packing": op10_packing,
    "op11_source_divergence": op11_source_divergence,
    "op12_embedding_near_dedup": op12_embedding_near_dedup,
    "op13_fill_in_middle": op13_fill_in_middle,
}

ORACLE_SQL: dict[str, str] = {
    "op1_license_scans": license_scan.oracle_sql(),
    "op7_suffix_array_dedup": repeats.oracle_sql(),
    "op9_ngram_jaccard_join": ngram_join.oracle_sql(),
    "op11_source_divergence": divergence.oracle_sql(),
    "op12_embedding_near_dedup": pivot_index.oracle_sql(),
    "op13_fill_in_middle": fill_middle.oracle_sql(),
}
