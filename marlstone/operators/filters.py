"""Ordered reject reasons, histograms over them and small predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reason_cascade(reasons: list[tuple[str, Column]]) -> Column:
    """The first reason whose condition is true; null where none is (the row is accepted)."""
    return F.coalesce(*(F.when(cond, F.lit(name)) for name, cond in reasons))


def rejection_counts(df: DataFrame, reason: str = "reason") -> DataFrame:
    return df.groupBy(F.coalesce(reason, F.lit("accepted")).alias(reason)).agg(F.count("*").alias("n"))


def all_of(conditions: list[Column | None]) -> Column:
    """Conjunction of the conditions that are given; true if none is."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def bounded_int(text: Column, limit: int) -> Column:
    """Digits only and no more than `limit`, as a long; null otherwise."""
    return F.when(text.rlike("^[0-9]{1,18}$"), F.when(text.try_cast("long") <= limit, text.try_cast("long")))


def tier(value: Column, thresholds: list[tuple[float, str]], otherwise: str) -> Column:
    """The name of the first threshold (falling) that the value reaches; null for null."""
    out = F.lit(otherwise)
    for least, name in sorted(thresholds):
        out = F.when(value >= least, F.lit(name)).otherwise(out)
    return F.when(value.isNotNull(), out)
