"""Cross-validation in grouped tasks: folds of whole groups, a grid of configurations tuned inside each outer fold, and the
union of what every fold's model predicts for rows that it never saw.

Rows reduce to cells (outer fold, inner fold, season, tier, break class) of counts and sums; a task fits one
configuration on the cells of its training folds and returns a prediction for each cell, so tasks are as many as
outer folds * configurations * inner folds, and each holds cells alone.  Errors are those of the rows: predictions are joined
to them, and a configuration's rank is its median absolute share error, then its 90 % quantile, both exact.

Cases: a null group is one group; with fewer groups than folds some folds are empty; an outer fold whose training part
is empty predicts nothing; equal configurations go to the first one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.operators import models
from marlstone.operators.ranking import numbered, quantiles
from marlstone.sources.shared import through_table

OUTER, INNER = 5, 3
RIDGES = (0.1, 1.0, 10.0, 100.0)


def balanced_folds(rows: DataFrame, within: list[str], group: str, folds: int, out: str) -> DataFrame:
    """Adds `out`: the fold of the row's group, inside each value of `within`: groups are dealt in order of falling size, to
    and fro, so folds are about equal in rows and in groups."""
    key = F.coalesce(F.col(group).cast("string"), F.lit("")).alias("_g")
    sizes = rows.groupBy(*within, key).agg(F.count("*").alias("_n"))
    ranked = numbered(sizes, within, [F.desc("_n"), F.col("_g")], "_r")
    turn = F.pmod(F.col("_r") - 1, F.lit(2 * folds))
    dealt = ranked.select(*within, "_g", F.least(turn, 2 * folds - 1 - turn).cast("int").alias(out))
    return rows.withColumn("_g", F.coalesce(F.col(group).cast("string"), F.lit(""))).join(dealt, [*within, "_g"]).drop("_g")


_PREDICTED = "outer int, config int, inner int, season int, tier string, break_class string, log_price double"


def _fitted(ridges: tuple[float, ...], seasons: int):
    """One task: trains on the cells marked so, and predicts every cell of the grid."""

    def run(table: pa.Table) -> pa.Table:
        got = table.to_pydict()
        out = {c.split()[0]: [] for c in _PREDICTED.split(", ")}
        if got["season"]:
            m = models._solve(*models._columns(got), ridges[got["config"][0]], rounds=500, seasons=seasons)
            price = m.season[:, None, None] + np.r_[0, m.tiers.cumsum()][None, :, None] + np.r_[0, m.breaks.cumsum()][None, None, :]
            for s, t, b in np.ndindex(price.shape):
                for name, value in zip(out, (got["outer"][0], got["config"][0], got["inner"][0], s, models.TIERS[t], models.BREAKS[b], float(price[s, t, b])), strict=True):
                    out[name].append(value)
        kinds = {"int": pa.int32(), "string": pa.string(), "double": pa.float64()}
        return pa.table({c.split()[0]: pa.array(out[c.split()[0]], kinds[c.split()[1]]) for c in _PREDICTED.split(", ")})

    return run


def _trained(cells: DataFrame, tasks: DataFrame, ridges: tuple[float, ...], seasons: int) -> DataFrame:
    """The predictions of each task (outer, config, inner): trained on cells of other outer folds and other inner folds (inner
    -1: on all of those outer folds)."""
    mine = (F.col("of") == F.col("outer")) & (F.col("fold") != F.col("inner"))
    held = cells.join(F.broadcast(tasks), mine)  # tasks: one for each of a small grid
    pooled = held.groupBy("outer", "config", "inner", "season", "tier", "break_class").agg(F.sum("n").alias("n"), F.sum("sy").alias("sy"))
    return through_table(pooled.groupBy("outer", "config", "inner").applyInArrow(_fitted(ridges, seasons), _PREDICTED), "predictions")


def cross_validated(rows: DataFrame, group: str, ridges: tuple[float, ...] = RIDGES, outer: int = OUTER, inner: int = INNER) -> tuple[DataFrame, DataFrame]:
    """rows (season, tier, break_class, y, group, ...) with outer, config (the ridge) and predicted, by the model of the row's
    outer fold; and for each outer fold and configuration its inner median and 90 % error, with `chosen`."""
    spark = rows.sparkSession
    x = through_table(balanced_folds(rows, [], group, outer, "outer"), "outer-folds")
    seasons = (x.agg(F.max("season")).first()[0] or 0) + 1
    # Of each outer fold the other folds' rows, dealt into inner folds by group.
    other = x.select("season", "tier", "break_class", "y", F.col(group).alias("g"), "outer")
    training = other.join(F.broadcast(spark.range(outer).select(F.col("id").cast("int").alias("of"))), F.col("of") != F.col("outer")).drop("outer")
    training = through_table(balanced_folds(training, ["of"], "g", inner, "fold"), "inner-folds")
    cells = through_table(training.groupBy("of", "fold", "season", "tier", "break_class").agg(F.count("*").alias("n"), F.sum("y").alias("sy")), "fold-cells")
    grid = spark.createDataFrame([(o, c, i) for o in range(outer) for c in range(len(ridges)) for i in range(inner)], "outer int, config int, inner int")
    known = lambda c, names: F.when(F.col(c).isin(*names), F.col(c)).otherwise(names[0])
    cell = lambda df: df.withColumns({"tier": known("tier", models.TIERS), "break_class": known("break_class", models.BREAKS)})
    guesses = _trained(cells, grid, ridges, seasons)
    met = cell(training).select(F.col("of").alias("outer"), F.col("fold").alias("inner"), "season", "tier", "break_class", "y").join(guesses, ["outer", "inner", "season", "tier", "break_class"])
    errors = met.select("outer", "config", F.abs(F.exp("log_price") / F.exp("y") - 1).alias("ape"))
    told = quantiles(errors, ["outer", "config"], "ape", [0.5, 0.9]).select("outer", "config", F.col("q0").alias("median_ape"), F.col("q1").alias("p90_ape"))
    best = Window.partitionBy("outer").orderBy("median_ape", "p90_ape", "config")  # a row for each configuration
    told = through_table(told.withColumn("chosen", F.row_number().over(best) == 1), "tuned")
    final = _trained(cells, told.filter("chosen").select("outer", "config", F.lit(-1).alias("inner")), ridges, seasons)
    ridge = F.element_at(F.array(*(F.lit(r) for r in ridges)), F.col("config") + 1)
    price = final.select("outer", "season", F.col("tier").alias("_t"), F.col("break_class").alias("_b"), ridge.alias("ridge"), F.exp("log_price").alias("predicted"))
    out = x.withColumns({"_t": known("tier", models.TIERS), "_b": known("break_class", models.BREAKS)}).join(price, ["outer", "season", "_t", "_b"], "left").drop("_t", "_b")
    return out, told.withColumn("ridge", ridge)
