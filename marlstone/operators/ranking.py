"""Exact quantiles and row numbers that no task needs a whole group for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.sources.shared import through_table

#: Buckets that a bracket is cut into; values that a bracket may hold to be sorted in one row.
BUCKETS, FEW = 4096, 8192


def _ladder(v: Column) -> Column:
    """A number that rises (weakly) with v: by the exponent, so that it spans all doubles; infinities and NaN come last."""
    size = F.log2(F.abs(v)) + 1075
    return F.when(F.isnan(v), 4000.0).when(F.abs(v) == float("inf"), F.signum(v) * 3000).when(v == 0, 0.0).otherwise(F.signum(v) * size)


def _bucket(v: Column, lo: Column, hi: Column) -> Column:
    """Which of BUCKETS ranges of the bracket v lies in: even ones of values where those are near each other, else of
    exponents; lo is always in the first and hi in the last, so a bracket of different values always splits."""
    near = (F.signum(lo) * F.signum(hi) > 0) & (F.greatest(F.abs(lo), F.abs(hi)) / 4 < F.least(F.abs(lo), F.abs(hi))) & (F.greatest(F.abs(lo), F.abs(hi)) < float("inf"))
    share = F.when(near, (v - lo) / (hi - lo)).otherwise((_ladder(v) - _ladder(lo)) / (_ladder(hi) - _ladder(lo)))
    return F.greatest(F.lit(0), F.least(F.lit(BUCKETS - 1), F.floor(share * BUCKETS)))


def quantiles(df: DataFrame, group: list[str], value: str, qs: list[float]) -> DataFrame:
    """A row for each group (a null key is one too): its columns, n (values that aren't null) and q0, q1, ...: the exact
    quantiles, linear between neighbours.  A group without values has no row.  Infinities are values like others, NaN is
    greater than all; between two different values of which one is infinite or NaN, the quantile is infinite or NaN.

    Each round counts the values of a bracket by BUCKETS ranges, summed where they lie, and keeps the range that holds
    the wanted rank, until FEW values are left or all are equal; so a group of any size is never in one task.  Ranges go
    by exponents first and evenly then, so some ten rounds are enough for any doubles."""
    v = df.filter(F.col(value).isNotNull()).select(F.struct(F.lit(1).alias("_1"), *group).alias("g"), F.col(value).cast("double").alias("v"))
    sizes = v.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    ranks = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(side).alias("side"), f(F.lit(q) * (F.col("n") - 1)).cast("long").alias("at")) for k, q in enumerate(qs) for side, f in (("low", F.floor), ("high", F.ceil))))
    wanted = sizes.select("g", "n", "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"), F.inline(ranks))
    wanted = through_table(wanted, "brackets")
    wide = (F.col("inside") > FEW) & (F.col("lo") < F.col("hi"))
    open_ = not wanted.filter(wide).isEmpty()
    v = through_table(v, "values") if open_ else v  # read once a round
    while open_:
        brackets = wanted.filter(wide).select("g", "lo", "hi").distinct()
        within = v.join(brackets, "g").filter(F.col("v").between(F.col("lo"), F.col("hi")))
        counted = within.groupBy("g", "lo", "hi", _bucket(F.col("v"), F.col("lo"), F.col("hi")).alias("b")).agg(F.count("*").alias("c"), F.min("v").alias("to_lo"), F.max("v").alias("to_hi"))
        before = F.sum("c").over(Window.partitionBy("g", "lo", "hi").orderBy("b")) - F.col("c")  # BUCKETS rows in a bracket
        counted = counted.withColumn("before", before)
        at = F.col("at") - F.col("below")
        met = wanted.join(counted, ["g", "lo", "hi"], "left").filter(F.col("c").isNull() | ((at >= F.col("before")) & (at < F.col("before") + F.col("c"))))
        met = met.select("g", "n", F.coalesce("to_lo", "lo").alias("lo"), F.coalesce("to_hi", "hi").alias("hi"), (F.col("below") + F.coalesce("before", F.lit(0))).alias("below"), F.coalesce("c", "inside").alias("inside"), "k", "side", "at")
        wanted = through_table(met, "brackets")
        open_ = not wanted.filter(wide).isEmpty()
    brackets = wanted.filter("lo < hi").select("g", "lo", "hi").distinct()
    held = v.join(brackets, "g").filter(F.col("v").between(F.col("lo"), F.col("hi"))).groupBy("g", "lo", "hi").agg(F.sort_array(F.collect_list("v")).alias("held"))  # FEW values at most
    picked = wanted.join(held, ["g", "lo", "hi"], "left").withColumn("x", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.get("held", F.col("at") - F.col("below"))))
    of = lambda k, side: F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("x")))
    out = picked.groupBy("g", "n").agg(*(of(k, s).alias(f"{s}{k}") for k in range(len(qs)) for s in ("low", "high")))
    def between(k, q):
        h = F.lit(q) * (F.col("n") - 1)
        low, high = F.col(f"low{k}"), F.col(f"high{k}")
        return F.when((low == high) | (h == F.floor(h)), low).otherwise(low + (h - F.floor(h)) * (high - low))

    return out.select(*(F.col("g").getField(c).alias(c) for c in group), "n", *(between(k, q).alias(f"q{k}") for k, q in enumerate(qs)))


def numbered(df: DataFrame, group: list[str], order: list[Column], out: str) -> DataFrame:
    """Adds `out`: the row number from 1 in the group by `order`, which must tell all rows apart.

    Rows are cut into ranges of (group, order), numbered within a range, and moved up by the rows of the group's earlier
    ranges; so a group that holds most rows is spread over many tasks."""
    ranged = df.repartitionByRange(*(F.col(g) for g in group), *order).withColumn("_part", F.spark_partition_id())
    ranged = through_table(ranged, "ranges")
    inner = Window.partitionBy("_part", *group).orderBy(*order)
    counts = ranged.groupBy("_part", *group).agg(F.count("*").alias("_c"))
    earlier = counts.withColumn("_before", F.sum("_c").over(Window.partitionBy(*group).orderBy("_part")) - F.col("_c"))  # a row for each range of a group
    earlier = earlier.select(F.col("_part").alias("_p"), *(F.col(g).alias(f"_g{k}") for k, g in enumerate(group)), "_before")
    same = F.col("_part") == F.col("_p")
    for k, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{k}"))
    placed = ranged.withColumn("_r", F.row_number().over(inner)).join(earlier, same)
    return placed.select(*df.columns, (F.col("_r") + F.col("_before")).cast("long").alias(out))
