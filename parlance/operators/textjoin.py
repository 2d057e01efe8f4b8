"""Best partners of texts by shared words, found from rare words first with bounds on what is still unseen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.text import match_tokens


def token_sets(df: DataFrame, key: str, text: str) -> DataFrame:
    """``id, w``: the distinct match tokens of each text, as 64-bit hashes."""
    return df.select(F.col(key).alias("id"), F.array_distinct(F.transform(match_tokens(F.col(text)), lambda t: F.xxhash64(t))).alias("w"))


def _exploded(tokens: str = "w") -> Column:
    """One row a token. The outer form, as the inner one's filter for empty arrays would tokenise each text once more; joins drop its nulls."""
    return F.explode_outer(tokens)


def postings(items: DataFrame) -> DataFrame:
    """``t, id2, n2, left``: each token of each item, with how many of the item's tokens are no rarer than it, itself included."""
    words = items.select("id", F.size("w").alias("n"), _exploded().alias("t"))
    known = words.filter("t IS NOT NULL").groupBy("t").agg(F.count("*").alias("df"))
    listed = words.join(known, "t").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "t"))).alias("w"))
    return listed.select(F.col("id").alias("id2"), F.col("n").alias("n2"), F.posexplode("w").alias("j", "x")).select(F.col("x.t").alias("t"), "id2", "n2", (F.col("n2") - F.col("j")).alias("left"))


def met(docs: DataFrame, index: DataFrame, least: Column) -> DataFrame:
    """Pairs (``id, id2``) of token sets that meet on a token at which containment can still reach ``least``, a column of ``docs``.

    If that is the first token they share, in the order of rarity, they share ``left`` tokens at most. A token that leaves too
    few in every item is no key of the join at all.
    """
    words = docs.select("id", F.size("w").alias("n"), least.alias("least"), _exploded().alias("t"))
    top = index.groupBy("t").agg(F.max(F.col("left") / F.col("n2")).alias("top"), F.max("n2").alias("longest"))
    fit = words.join(top, "t").filter((F.col("top") >= F.col("least")) | (F.col("n") < F.col("longest"))).drop("top", "longest")
    return fit.join(index, "t").filter(F.least("left", "n") / F.least("n", "n2") >= F.col("least")).select("id", "id2").distinct()


def compared(pairs: DataFrame, docs: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs with the exact containment and Jaccard of their tokens."""
    both = pairs.join(docs, "id").join(items.select(F.col("id").alias("id2"), F.col("w").alias("w2")), "id2")
    k, n, n2 = F.size(F.array_intersect("w2", "w")), F.size("w"), F.size("w2")
    return both.select("id", "id2", n.alias("n"), n2.alias("n2"), k.alias("k")).select("id", "id2", (F.col("k") / F.least("n", "n2")).alias("containment"), (F.col("k") / (F.col("n") + F.col("n2") - F.col("k"))).alias("jaccard"))


def best_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", first: float = 0.5) -> DataFrame:
    """For each document the item it shares most tokens with: ``doc_id, item_id, containment, jaccard``.

    The best is by containment, then Jaccard, then the least item. A document that shares no token with any has no row. Exact in two
    steps: pairs that can reach ``first`` meet on their rare tokens and give each document a containment it has for sure; then only
    those pairs meet that can still reach that. Tokens in most items are keys for documents alone that have nothing better.
    """
    a, b = token_sets(docs, doc_id, text), token_sets(items, item_id, text)
    index = postings(b)
    sure = compared(met(a, index, F.lit(first)), a, b).groupBy("id").agg(F.max("containment").alias("sure"))
    scored = compared(met(a.join(sure, "id", "left"), index, F.coalesce("sure", F.lit(0.0))), a, b)
    best = scored.groupBy("id").agg(F.min_by(F.struct("id2", "containment", "jaccard"), F.struct((-F.col("containment")).alias("c"), (-F.col("jaccard")).alias("j"), "id2")).alias("x"))
    return best.select(F.col("id").alias(doc_id), F.col("x.id2").alias(item_id), "x.containment", "x.jaccard")
