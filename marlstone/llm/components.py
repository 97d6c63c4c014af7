"""Connected components of an edge table, by rounds of least labels with pointer jumping.

Cases: an empty edge table has no nodes; loops and repeated edges count for nothing; edges with a null are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.runtime import through_table


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label) of every node of `edges` (a, b): label is the least node of its component.

    Each round hangs every neighbour of a node, and the node, below the least of them (large-star, then small-star),
    so the number of rounds is logarithmic in the longest path; every round ends in a written table."""
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    e = through_table(e, "edges")
    for _ in range(most_rounds):
        # Done when every edge points at a root and each node has one edge.
        ends = e.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("v").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        open_ = ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR up + down > 1")
        if open_.isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        e = through_table(small.filter("u <> v").distinct(), "edges")
    raise RuntimeError("components did not settle")
