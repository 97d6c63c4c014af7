"""A small price model: season intercepts shrunk to a trend, tier effects that never fall, break effects that never rise.

Rows reduce to cells (season, tier, break class) of counts and sums in Spark; there are 25 for each season at most, whatever
the number of rows, so the coordinate descent runs on the driver.  Prediction is a column expression.

Cases: a season is a quarter that occurs, so a stray date adds one; of more than MOST_SEASONS quarters neighbours share a
season; a row without a price or a date takes no part; an unknown tier or break class counts as the first one; without
rows all effects are 0."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.text import round_price
from marlstone.operators.filters import tier

TIERS, BREAKS = ("few", "medium", "many", "hundred"), ("none", "slight", "medium", "large")


#: Seasons at most.
MOST_SEASONS = 120


def _index(c: str, names: tuple[str, ...]) -> Column:
    return F.greatest(F.coalesce(F.array_position(F.array(*(F.lit(x) for x in names)), F.col(c)), F.lit(0)).cast("int") - 1, F.lit(0))


def levels(found: list, names: tuple[str, ...]) -> np.ndarray:
    """The place of each name; unknown ones count as the first."""
    return np.array([names.index(x) if x in names else 0 for x in found], int)


def priced_rows(lineitem: DataFrame) -> DataFrame:
    """Line items with a price and a date, with a season (a quarter's place among those that occur), a tier, a break class and y = ln(price)."""
    usable = lineitem.filter("l_extendedprice > 0 AND l_shipdate IS NOT NULL").withColumn("quarter", F.year("l_shipdate") * 4 + F.quarter("l_shipdate") - 1)
    quarters = sorted(r["quarter"] for r in usable.select("quarter").distinct().collect())  # as many as the calendar has
    places = [(q, k if len(quarters) <= MOST_SEASONS else k * MOST_SEASONS // len(quarters)) for k, q in enumerate(quarters)]
    seasons = lineitem.sparkSession.createDataFrame(places, "quarter int, season int")
    named = usable.join(F.broadcast(seasons), "quarter").drop("quarter").withColumn("tier", tier(F.col("l_quantity") * 2, [(90, "hundred"), (60, "many"), (30, "medium")], "few"))
    named = named.withColumn("tier", F.when(F.col("l_quantity").isNotNull(), F.col("tier"))).withColumn("break_class", tier(F.col("l_discount"), [(0.08, "large"), (0.05, "medium"), (0.02, "slight")], "none"))
    return named.withColumn("break_class", F.when(F.col("l_discount").isNotNull(), F.col("break_class"))).withColumn("y", F.ln("l_extendedprice"))


def cells(rows: DataFrame) -> DataFrame:
    return rows.groupBy("season", "tier", "break_class").agg(F.count("*").alias("n"), F.sum("y").alias("sy"))


@dataclass
class Model:
    season: np.ndarray
    tiers: np.ndarray
    breaks: np.ndarray
    rounds: int

    def log_price(self) -> Column:
        pick = lambda v, i: F.element_at(F.array(*(F.lit(float(x)) for x in v)), i + 1)
        return pick(self.season, F.col("season")) + pick(np.r_[0, self.tiers.cumsum()], _index("tier", TIERS)) + pick(np.r_[0, self.breaks.cumsum()], _index("break_class", BREAKS))


def _solve(season: np.ndarray, t: np.ndarray, b: np.ndarray, n: np.ndarray, sy: np.ndarray, ridge: float, rounds: int = 5000, tolerance: float = 1e-8, seasons: int = 0) -> Model:
    """Coordinate descent: steps between tiers are 0 or more, steps between break classes 0 or less."""
    seasons = seasons or int(season.max()) + 1
    at = np.zeros(seasons)
    steps_t, steps_b = np.zeros(len(TIERS) - 1), np.zeros(len(BREAKS) - 1)
    seen = np.bincount(season, n, seasons) > 0
    x = np.arange(seasons, dtype=float)
    for k in range(1, rounds + 1):
        old = np.r_[at, steps_t, steps_b]
        effect = np.r_[0, steps_t.cumsum()][t] + np.r_[0, steps_b.cumsum()][b]
        w, target = np.bincount(season, n, seasons), np.bincount(season, sy - n * effect, seasons)
        mean = np.divide(target, w, out=np.zeros(seasons), where=w > 0)
        slope, level = np.polyfit(x[seen], mean[seen], 1, w=np.sqrt(w[seen])) if seen.sum() > 1 else (0.0, mean[seen].mean())
        at = (target + ridge * (level + slope * x)) / (w + ridge)
        for steps, code, sign in ((steps_t, t, 1), (steps_b, b, -1)):
            for j in range(len(steps)):
                over = code > j
                rest = at[season] + np.r_[0, steps_t.cumsum()][t] + np.r_[0, steps_b.cumsum()][b] - over * steps[j]
                wj = n[over].sum()
                best = (sy[over] - n[over] * rest[over]).sum() / (wj + ridge) if wj else 0.0
                steps[j] = max(0.0, best) if sign > 0 else min(0.0, best)
        if np.abs(np.r_[at, steps_t, steps_b] - old).max() < tolerance:
            break
    return Model(at, steps_t, steps_b, k)


def _columns(got: dict) -> tuple[np.ndarray, ...]:
    return np.array(got["season"], int), levels(got["tier"], TIERS), levels(got["break_class"], BREAKS), np.array(got["n"], float), np.array(got["sy"], float)


def fit_cells(cell_table: DataFrame, ridge: float = 1.0) -> Model:
    """Fits from the cell table (25 rows a season at most)."""
    got = cell_table.toArrow().to_pydict()
    return _solve(*_columns(got), ridge) if got["season"] else Model(np.zeros(1), np.zeros(len(TIERS) - 1), np.zeros(len(BREAKS) - 1), 0)


def predict(rows: DataFrame, model: Model) -> DataFrame:
    return rows.withColumn("predicted", F.exp(model.log_price())).withColumn("residual", F.col("y") - model.log_price())


def predict_or_say(inputs: DataFrame, model: Model, spreads: dict[int, float], pooled: tuple[float, float] | None) -> DataFrame:
    """`inputs` (season, tier, break_class) with status, reason, midpoint, low, high and method.

    A null season is priced by the pooled base (log base, spread), another by its own; a season that the model hasn't, or
    one without a spread, gives `unavailable` with a reason, and so does a model whose steps go the wrong way."""
    sound = bool((model.tiers >= 0).all() and (model.breaks <= 0).all() and np.isfinite(model.season).all())
    known = [s for s in sorted(spreads) if 0 <= s < len(model.season) and np.isfinite(spreads[s]) and spreads[s] >= 0]
    bases = [(s, float(model.season[s]), float(spreads[s]), "season") for s in known] + ([(None, float(pooled[0]), float(pooled[1]), "pooled")] if pooled else [])
    table = inputs.sparkSession.createDataFrame(bases, "_s int, _base double, _spread double, method string")
    pick = lambda v, i: F.element_at(F.array(*(F.lit(float(x)) for x in v)), i + 1)
    log = F.col("_base") + pick(np.r_[0, model.tiers.cumsum()], _index("tier", TIERS)) + pick(np.r_[0, model.breaks.cumsum()], _index("break_class", BREAKS))
    met = inputs.join(F.broadcast(table), F.col("season").eqNullSafe(F.col("_s")), "left").withColumn("_log", log)
    reason = F.when(F.lit(not sound), "model_not_ready").when(F.col("_base").isNull(), "invalid_model_season").when(~F.exp("_log").between(1e-300, 1e300), "invalid_prediction")
    price = lambda d: F.when(F.col("reason").isNull(), round_price(F.exp(F.col("_log") + d * F.col("_spread"))))
    told = met.withColumn("reason", reason).withColumns({"status": F.when(F.col("reason").isNull(), "unvalidated").otherwise("unavailable"), "midpoint": price(0)})
    return told.withColumns({"low": F.least(price(-1), "midpoint"), "high": F.greatest(price(1), "midpoint"), "method": F.when(F.col("reason").isNull(), F.col("method"))}).drop("_s", "_base", "_spread", "_log")


def project(grid: DataFrame, sweeps: int = 30) -> DataFrame:
    """Sweeps over the grid until values don't fall along tiers nor rise along break classes, nor rise along seasons."""
    got = grid.toArrow().to_pydict()
    v = np.full((max(got["season"], default=0) + 1, len(TIERS), len(BREAKS)), np.nan)
    for s, t, b, m in zip(got["season"], got["tier"], got["break_class"], got["m"], strict=True):
        v[s, TIERS.index(t), BREAKS.index(b)] = m
    for _ in range(sweeps):
        old = v.copy()
        v = np.fmax.accumulate(v, axis=1)
        v = np.fmin.accumulate(v, axis=2)
        v = np.fmin.accumulate(v, axis=0)
        if np.array_equal(old, v, equal_nan=True):
            break
    rows = [(s, TIERS[t], BREAKS[b], round(float(v[s, t, b]), 6)) for s, t, b in np.argwhere(~np.isnan(v)).tolist()]
    return grid.sparkSession.createDataFrame(rows, "season int, tier string, break_class string, projected double")


def tune(cell_sums: DataFrame, ridges: tuple[float, ...] = (0.1, 1.0, 10.0, 100.0)) -> DataFrame:
    """For each outer fold, the ridge of least squared error over inner folds, from cell sums by fold."""
    got = cell_sums.toArrow().to_pydict()
    fold, syy = np.array(got["fold"], int), np.array(got["syy"], float)
    parts = _columns(got)

    def error(train: np.ndarray, test: np.ndarray, ridge: float) -> float:
        m = _solve(*(c[train] for c in parts), ridge, rounds=200, seasons=int(parts[0].max()) + 1)
        s, t, b, n, sy = (c[test] for c in parts)
        p = m.season[s] + np.r_[0, m.tiers.cumsum()][t] + np.r_[0, m.breaks.cumsum()][b]
        return float((syy[test] - 2 * p * sy + n * p * p).sum())

    rows = []
    for outer in sorted(set(fold)):
        inner = [k for k in sorted(set(fold)) if k != outer]
        losses = [sum(error((fold != outer) & (fold != k), fold == k, r) for k in inner) for r in ridges]
        best = ridges[int(np.argmin(losses))]
        n = float(parts[3][fold == outer].sum())
        rows.append((int(outer), best, round((error(fold != outer, fold == outer, best) / n) ** 0.5, 6)))
    return cell_sums.sparkSession.createDataFrame(rows, "fold int, ridge double, rmse double")
