"""Error metrics of predictions, shrunk statistics and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.operators.ranking import quantiles


def ape(actual: Column, predicted: Column) -> Column:
    return F.abs(predicted - actual) / actual


def accuracy(df: DataFrame, keys: list[str], prediction: str = "predicted", error: str = "ape") -> DataFrame:
    """By `keys`: counts, hit rates, quantiles and the 95 % Wilson interval of the 10 % hits.

    Failed predictions stay in the denominators and null the quantiles."""
    n, z2 = F.col("n"), 1.959963984540054**2
    hit = lambda t: F.count_if(F.col(error) <= t + 1e-12) / F.count("*")
    cell = F.struct(F.lit(1).alias("_1"), *keys).alias("_g")
    counts = df.groupBy(cell).agg(F.count("*").alias("n"), F.count_if(F.col(prediction).isNull()).alias("failed"), hit(0.1).alias("h"), hit(0.2).alias("h20"))
    q = quantiles(df, keys, error, [0.5, 0.9]).select(cell, "q0", "q1")
    h = F.col("h")
    half = 1.959963984540054 * F.sqrt(h * (1 - h) / n + z2 / (4 * n * n))
    whole = lambda c: F.round(F.when(F.col("failed") == 0, F.col(c)), 6)
    return counts.join(q, "_g", "left").select(
        *(F.col("_g").getField(k).alias(k) for k in keys),
        "n",
        "failed",
        F.round(h, 6).alias("hit10"),
        F.round("h20", 6).alias("hit20"),
        F.round((h + z2 / (2 * n) - half) / (1 + z2 / n), 6).alias("wilson_low"),
        F.round((h + z2 / (2 * n) + half) / (1 + z2 / n), 6).alias("wilson_high"),
        whole("q0").alias("median_ape"),
        whole("q1").alias("p90_ape"),
    )


def shrunk(local: Column, n: Column, fallback: Column, strength: float) -> Column:
    """(n * local + strength * fallback) / (n + strength)."""
    return (n * local + F.lit(strength) * fallback) / (n + F.lit(strength))


def weighted_trend(x: Column, y: Column, weight: Column) -> tuple[Column, Column]:
    """Slope and intercept of weighted least squares, as aggregates (means first, so that no large squares cancel)."""
    w, wx, wy, wxy, wxx = (F.sum(weight * c) for c in (F.lit(1.0), x, y, x * y, x * x))
    slope = (wxy - wx * wy / w) / (wxx - wx * wx / w)
    return slope, (wy - slope * wx) / w


def release_gate(old: DataFrame, new: DataFrame, frozen: DataFrame) -> DataFrame:
    """From one-row tables of `accuracy` (the serving model, the candidate, the candidate on the serving model's own
    rows): the gate's checks, whether all hold, and what follows."""
    names = ("hit20", "median_ape", "p90_ape", "failed")
    one = lambda d, p: d.select(*(F.col(c).alias(f"{p}_{c}") for c in names), F.lit(1).alias("_k"))
    j = one(old, "old").join(one(new, "new"), "_k").join(one(frozen, "frozen"), "_k")
    checks = {
        "median_better": F.col("new_median_ape") <= F.col("old_median_ape") - 0.01,
        "hit_not_lower": F.col("new_hit20") >= F.col("old_hit20"),
        "p90_not_worse": F.col("new_p90_ape") <= F.col("old_p90_ape"),
        "frozen_not_much_worse": F.col("frozen_median_ape") <= F.col("old_median_ape") + 0.03,
        "none_failed": F.col("new_failed") == 0,
    }
    out = j.select(*(F.coalesce(c, F.lit(False)).alias(k) for k, c in checks.items()))
    return out.withColumn("release", F.when(F.expr(" AND ".join(checks)), "publish").otherwise("retain_current"))
