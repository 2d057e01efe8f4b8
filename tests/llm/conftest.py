import pytest

CLASHES = ["th", "s", "n", "a", "b", "v", "cover", "root", "size", "sig", "bands", "kept", "hits", "list", "draw", "ids", "score", "rank", "value", "rule", "host"]


@pytest.fixture
def odd_docs(spark):
    """Rows with nulls, empties, a very long text, repeats, and columns named like those inside the operators."""
    from pyspark.sql import functions as F

    long = " ".join(f"word{i * 7919 % 10007}" for i in range(20_000))
    passage = "the quick brown fox jumps over the lazy dog near the old stone bridge while many people watch from the other side " * 2
    rows = [
        (1, "A short text with cc by inside.", "en"), (2, None, "en"), (3, "", None), (None, "no id here but some words to read, all rights reserved", "en"), (4, long, "en"), (5, long, "en"),
        (6, "same words again and again " * 30, "de"), (6, "same words again and again " * 30, "de"), (7, " \n\t ", None), (8, passage + "one ending of a text", "fr"), (9, "another beginning " + passage, "fr"), (10, "日本語のテキスト émile ñandú 😀 12345", "ja"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))
    for c in CLASHES:
        df = df.withColumn(c, F.lit(c))
    return df


@pytest.fixture
def no_docs(odd_docs):
    return odd_docs.limit(0)
