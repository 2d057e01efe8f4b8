"""A corpus pipeline of the operators in ``parlance.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as
the next stage's ``docs``. All stages but the last return the columns of ``documents``. A stage
deletes the working tables of the one before it, whose result is written by then; those that its own
``docs`` still read are left.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from parlance.llm import ngram_join, packing, pii, quality, repeats
from parlance.llm.queries import PSEUDONYM_KEY, tokenizer_file
from parlance.llm.scratch import materialise, release, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_WORKING: list[str] = []


def _stage(f: Stage) -> Stage:
    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = docs.inputFiles()
        release(spark, [p for p in _WORKING if not any(p.rsplit("/", 1)[-1] in f for f in read)])
        before = set(written())
        out = f(spark, docs, sf_dir)
        _WORKING[:] = [p for p in written() if p not in before]
        return out

    return run_stage


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the posterior reject go."""
    return quality.keep_good(docs)


@_stage
def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the least id stays."""
    return ngram_join.keep_one(docs)


@_stage
def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes under a repeated 200-byte string go, wherever it stands; documents stay."""
    return repeats.remove_repeats(docs, count_col="n_chars")


@_stage
def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by linked pseudonyms."""
    return pii.replaced(docs, PSEUDONYM_KEY, count_col="n_chars")


@_stage
def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, in windows of 4096 ids."""
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("suffix_array_dedup", suffix_array_dedup),
    ("pii", pseudonyms),
    ("packing", pack_windows),
]

#: Estimated posteriors, pseudonyms and packing have no SQL; tests hold run() against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
