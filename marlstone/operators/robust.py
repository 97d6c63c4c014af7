"""Robust outliers on log prices within groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.operators.ranking import quantiles


def mad_outliers(df: DataFrame, group: list[str], price: str, candidate: Column | None = None, z_limit: float = 5.0, least: int = 5) -> DataFrame:
    """Adds log_price, n_group, robust_z, is_outlier and quality_flags.

    Median and MAD come from candidate rows with a positive price only; flags are given to all rows.  A price that is
    not positive is an outlier.  Where the MAD is zero, a price ten times or a tenth of the median price is one.  A
    group of fewer than `least` comparable rows, or none, marks nothing but says so."""
    candidate = F.lit(True) if candidate is None else candidate
    logged = df.withColumn("log_price", F.when(F.col(price) > 0, F.ln(price))).withColumn("_c", F.coalesce(candidate, F.lit(False)))
    usable = logged.filter(F.col("_c") & F.col("log_price").isNotNull())
    centre = quantiles(usable, group, "log_price", [0.5]).select(*group, F.col("q0").alias("_m"), F.col("n").alias("_n"))
    far = usable.join(centre, group).select(*group, F.abs(F.col("log_price") - F.col("_m")).alias("_d"))
    spread = centre.join(quantiles(far, group, "_d", [0.5]).select(*group, F.col("q0").alias("_mad")), group)
    off = F.abs(F.col("log_price") - F.col("_m"))
    z = F.when(F.col("_mad") > 0, F.lit(0.6745) * off / F.col("_mad"))
    enough = F.coalesce(F.col("_n"), F.lit(0)) >= least
    bad = F.when(F.col("log_price").isNull(), True).when(~enough, False).when(F.col("_mad") > 0, z > z_limit).otherwise(off >= F.lit(2.302585092994046))
    flags = F.array(F.when(F.col("log_price").isNull(), F.lit("invalid_price")), F.when(~enough, F.lit("small_group")), F.when(bad, F.lit("price_outlier")))
    return (
        logged.join(spread, group, "left")
        .withColumn("n_group", F.coalesce(F.col("_n"), F.lit(0)).cast("long"))
        .withColumn("robust_z", F.when(enough, z))
        .withColumn("is_outlier", F.coalesce(bad, F.lit(False)))
        .withColumn("quality_flags", F.filter(flags, lambda x: x.isNotNull()))
        .drop("_m", "_n", "_mad", "_c")
    )
