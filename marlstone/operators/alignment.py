"""Joins of two ordered lists by position between rows that are known to match."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EDGE, INNER = 8, 16


def anchored(anchors: DataFrame, sizes: DataFrame, group: str, edge: int = EDGE, inner: int = INNER) -> DataFrame:
    """(group, i, j): places that match because they lie alike in gaps of equal length between neighbouring anchors.

    anchors: (group, i, j), places from 1 in both lists; sizes: (group, n_i, n_j), the lists' lengths.  A gap at an end may
    hold `edge` places, another `inner`.  A group whose anchors cross matches nothing more."""
    start = sizes.select(group, F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), F.lit(True).alias("end"))
    stop = sizes.select(group, (F.col("n_i") + 1).alias("i"), (F.col("n_j") + 1).alias("j"), F.lit(True).alias("end"))
    every = anchors.select(group, "i", "j", F.lit(False).alias("end")).unionByName(start).unionByName(stop)
    w = Window.partitionBy(group).orderBy("i", "j")
    gaps = every.select(group, "i", "j", "end", F.lag("i").over(w).alias("i0"), F.lag("j").over(w).alias("j0"), F.lag("end").over(w).alias("end0")).filter("i0 IS NOT NULL")
    crossed = gaps.filter("j <= j0 OR i <= i0").select(group).distinct()
    size = F.col("i") - F.col("i0") - 1
    most = F.when(F.col("end") | F.col("end0"), edge).otherwise(inner)
    fit = gaps.join(crossed, group, "left_anti").filter((size > 0) & (size == F.col("j") - F.col("j0") - 1) & (size <= most))
    return fit.select(group, "i0", "j0", F.explode(F.sequence(F.lit(1).cast("long"), size)).alias("k")).select(group, (F.col("i0") + F.col("k")).alias("i"), (F.col("j0") + F.col("k")).alias("j"))


def resolved(rows: DataFrame, catalog: DataFrame, accepted: DataFrame, key: str, name: str, item: str, category: str) -> DataFrame:
    """(key, item) of rows that no accepted match has, whose name is that of one catalog item only, of the same category."""
    only = catalog.groupBy(F.col(name).alias("_n")).agg(F.count("*").alias("_c"), F.min(item).alias(item), F.min(category).alias("_k")).filter("_c = 1")
    left = rows.join(accepted.select(key), key, "left_anti")
    return left.join(only, F.col(name) == F.col("_n")).filter(F.col("_k") == F.col(category)).select(key, item)
