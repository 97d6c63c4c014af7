"""Snapshots and series: merging observations, change history, gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def snapshot_merge(df: DataFrame, key: list[str], at: str, tie: str, snapshot: Column, complete: Column, values: list[str], carried: list[str], base: str | None = None, based: tuple[str, ...] = ()) -> DataFrame:
    """One row for each key: first and last seen, the number of snapshots, whether any or the latest is complete.

    `values` are those of the newest row, nulls too: what it says not to know is not known.  `carried` are fields that
    a row may lack: their latest value that isn't null.  `based` are fields that the newest row may lack: they then come from
    the newest row that has a `base` (a text that isn't empty), and from no other."""
    newest = F.struct(F.col(at), F.col(tie))
    last = F.max(F.struct(newest.alias("o"), F.struct(complete.alias("_complete"), *values).alias("v")))
    found = df.groupBy(*key).agg(
        F.min(at).alias("first_seen_at"),
        F.max(at).alias("last_seen_at"),
        F.count_distinct(snapshot).alias("observation_count"),
        F.coalesce(F.max(complete), F.lit(False)).alias("seen_in_complete_snapshot"),
        last.alias("_last"),
        *(F.max_by(c, F.when(F.col(c).isNotNull(), newest)).alias(c) for c in carried),
        *([F.max(F.struct(newest.alias("o"), F.struct(*based).alias("v"))).alias("_new"), F.max(F.when(F.col(base) != "", F.struct(newest.alias("o"), F.struct(*based).alias("v")))).alias("_base")] if based else []),
    )
    kept = ("first_seen_at", "last_seen_at", "observation_count", "seen_in_complete_snapshot")
    return found.select(*key, *kept, F.coalesce("_last.v._complete", F.lit(False)).alias("latest_snapshot_complete"), *(F.col("_last.v").getField(c).alias(c) for c in values), *carried, *(F.coalesce(F.col("_new.v").getField(c), F.col("_base.v").getField(c)).alias(c) for c in based))


def change_history(df: DataFrame, key: list[str], at: str, tie: str, values: list[str]) -> DataFrame:
    """Observations with all `values` known of which one differs from the previous observation; only for keys with more
    than one such."""
    w = Window.partitionBy(*key).orderBy(at, tie)
    known = df.dropna(subset=values).withColumn("_v", F.struct(*values))
    valid = known.withColumn("_prev", F.lag("_v").over(w))
    kept = valid.filter(F.col("_prev").isNull() | (F.col("_v") != F.col("_prev"))).drop("_prev", "_v")
    return kept.withColumn("_n", F.count("*").over(Window.partitionBy(*key))).filter("_n > 1").drop("_n")


def interpolate(df: DataFrame, group: list[str], axis: str, value: str) -> DataFrame:
    """Adds `filled`: between observed neighbours linear in `axis`; outside, along the slope of the two nearest observed.

    A row carries its two neighbours and the two first and last observed points of its group, no list of them."""
    w, back = Window.partitionBy(*group).orderBy(axis), Window.partitionBy(*group).orderBy(F.desc(axis))
    whole = lambda o: o.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = F.when(F.col(value).isNotNull(), F.struct(F.col(axis).cast("double").alias("x"), F.col(value).cast("double").alias("y")))
    points = {
        "_p": F.last(seen, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_n": F.first(seen, True).over(w.rowsBetween(0, Window.unboundedFollowing)),
        "_first": F.nth_value(seen, 1, True).over(whole(w)), "_second": F.nth_value(seen, 2, True).over(whole(w)),
        "_last": F.nth_value(seen, 1, True).over(whole(back)), "_prior": F.nth_value(seen, 2, True).over(whole(back)),
    }
    x, c = F.col(axis).cast("double"), F.col

    def line(a: str, b: str) -> Column:
        a, b = c(a), c(b)
        return a["y"] + (b["y"] - a["y"]) * (x - a["x"]) / (b["x"] - a["x"])

    filled = F.when(c(value).isNotNull(), c(value).cast("double")).when(c("_p").isNotNull() & c("_n").isNotNull(), line("_p", "_n")).when(c("_second").isNull(), c("_first")["y"]).when(c("_p").isNotNull(), line("_prior", "_last")).otherwise(line("_first", "_second"))
    return df.withColumns(points).withColumn("filled", filled).drop(*points)
