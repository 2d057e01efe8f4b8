"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.scratch import materialise


#: Parts that a node's edges are dealt in, so that a hub is not one task's work.
PARTS = 16


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's (larger, or smaller and own) neighbours linked to its smallest neighbour.

    The smallest neighbour is found over the node's parts, and sent back to each part there is.
    """
    both = edges.select(F.col("u").alias("n"), F.col("v").alias("m"))
    if large:
        both = both.unionByName(edges.select(F.col("v").alias("n"), F.col("u").alias("m")))
    both = both.withColumn("part", F.pmod(F.xxhash64("m"), F.lit(PARTS)).cast("int"))
    parts = both.groupBy("n", "part").agg(F.min("m").alias("low"))
    least = parts.groupBy("n").agg(F.least(F.min("low"), F.first("n")).alias("least"))
    low = parts.select("n", "part").join(least, "n").select("n", "part", F.col("least").alias("low"))
    linked = both.join(low, ["n", "part"])
    if large:
        out = linked.filter(F.col("m") > F.col("n")).select(F.col("m").alias("u"), F.col("low").alias("v"))
    else:
        out = linked.select(F.col("m").alias("u"), F.col("low").alias("v")).unionByName(least.select(F.col("n").alias("u"), F.col("least").alias("v")))
    return out.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v longs); root is the component's least node.

    Edges stay linear in number: each step keeps a star for each node. A round is written to the
    shared folder, and the loop ends when a round changes nothing; not to settle in ``most_rounds`` is an error.
    """
    now = materialise(edges.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    for _ in range(most_rounds):
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            break
        mark = seen
        now = materialise(_star(_star(now, True), False), "edges")
    else:
        raise RuntimeError(f"components have not settled in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
