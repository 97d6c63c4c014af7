"""Evaluation queries (errors of a group-median prediction) and the small price model."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.operators import metrics as M
from marlstone.operators import models
from marlstone.operators.ranking import numbered, quantiles
from marlstone.operators.validation import cross_validated
from marlstone.sources.shared import through_table
from marlstone.sources.tables import table

QUERIES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


_PRED = "WITH g AS (SELECT o_orderpriority AS p, o_orderstatus AS s, quantile_cont(o_totalprice, 0.5) AS m FROM orders WHERE o_orderkey % 4 <> 0 AND NOT (o_orderpriority = '5-LOW' AND o_orderstatus = 'P') GROUP BY ALL), e AS (SELECT o_orderkey, o_orderpriority AS p, o_orderstatus AS s, o_totalprice AS actual, m AS predicted, abs(m - o_totalprice) / o_totalprice AS ape FROM orders LEFT JOIN g ON o_orderpriority = g.p AND o_orderstatus = g.s WHERE o_orderkey % 4 = 0) "


def _predicted(spark, sf):
    """A quarter of the orders, predicted by their cell's median over the others; one cell has no prediction."""
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("p"), F.col("o_orderstatus").alias("s"), F.col("o_totalprice").alias("actual"))
    g = quantiles(o.filter("o_orderkey % 4 <> 0 AND NOT (p = '5-LOW' AND s = 'P')"), ["p", "s"], "actual", [0.5]).select("p", "s", F.col("q0").alias("predicted"))
    return o.filter("o_orderkey % 4 = 0").join(g, ["p", "s"], "left").withColumn("ape", M.ape(F.col("actual"), F.col("predicted")))


def _metric_sql(keys: str, source: str) -> str:
    return f"""SELECT {keys} n, failed, round(h, 6) AS hit10, round(h20, 6) AS hit20,
      round((h + 3.8414588206941236 / (2 * n) - 1.959963984540054 * sqrt(h * (1 - h) / n + 3.8414588206941236 / (4 * n * n))) / (1 + 3.8414588206941236 / n), 6) AS wilson_low,
      round((h + 3.8414588206941236 / (2 * n) + 1.959963984540054 * sqrt(h * (1 - h) / n + 3.8414588206941236 / (4 * n * n))) / (1 + 3.8414588206941236 / n), 6) AS wilson_high,
      round(CASE WHEN failed = 0 THEN q50 END, 6) AS median_ape, round(CASE WHEN failed = 0 THEN q90 END, 6) AS p90_ape
      FROM (SELECT {keys} count(*) AS n, count(*) FILTER (predicted IS NULL) AS failed, count(*) FILTER (ape <= 0.1 + 1e-12) / count(*) AS h, count(*) FILTER (ape <= 0.2 + 1e-12) / count(*) AS h20, quantile_cont(ape, 0.5) AS q50, quantile_cont(ape, 0.9) AS q90 FROM {source})"""


@query(_PRED + _metric_sql("s,", "e GROUP BY s"))
def accuracy_metrics(spark, sf):
    return M.accuracy(_predicted(spark, sf), ["s"])


@query(_PRED + "SELECT p, round(count(*) FILTER (ape <= 0.1 + 1e-12) / count(*), 6) AS hit10, round(count(*) FILTER (ape <= 0.2 + 1e-12) / count(*), 6) AS hit20, round(count(*) FILTER (ape <= 0.3 + 1e-12) / count(*), 6) AS hit30, count(*) FILTER (predicted > actual * 1.2) AS over20, count(*) FILTER (predicted < actual * 0.8) AS under20 FROM e GROUP BY 1")
def hit_rates(spark, sf):
    hit = lambda t: F.round(F.count_if(F.col("ape") <= t / 100 + 1e-12) / F.count("*"), 6).alias(f"hit{t}")
    return _predicted(spark, sf).groupBy("p").agg(hit(10), hit(20), hit(30), F.count_if(F.col("predicted") > F.col("actual") * 1.2).alias("over20"), F.count_if(F.col("predicted") < F.col("actual") * 0.8).alias("under20"))


@query(_PRED + ", t AS (SELECT CASE WHEN p IS NOT NULL THEN 'priority' WHEN s IS NOT NULL THEN 'status' ELSE 'overall' END AS stratum, coalesce(p, s, 'all') AS stratum_value, count(*) AS n, count(*) FILTER (predicted IS NULL) AS failed, round(count(*) FILTER (ape <= 0.2 + 1e-12) / count(*), 6) AS hit20 FROM e GROUP BY GROUPING SETS ((), (p), (s))) SELECT * FROM t")
def stratified_metrics(spark, sf):
    hit = F.round(F.count_if(F.col("ape") <= 0.2 + 1e-12) / F.count("*"), 6)
    e = _predicted(spark, sf).groupingSets([[], ["p"], ["s"]], "p", "s").agg(F.count("*").alias("n"), F.count_if(F.col("predicted").isNull()).alias("failed"), hit.alias("hit20"))
    stratum = F.when(F.col("p").isNotNull(), "priority").when(F.col("s").isNotNull(), "status").otherwise("overall")
    return e.select(stratum.alias("stratum"), F.coalesce("p", "s", F.lit("all")).alias("stratum_value"), "n", "failed", "hit20")


@query(_PRED + ", c AS (SELECT p, count(*) FILTER (predicted IS NULL) AS failed, quantile_cont(ape, 0.5) AS median_ape, count(*) FILTER (ape <= 0.2) / count(*) AS hit20 FROM e GROUP BY 1) SELECT arg_min(p, median_ape) AS best_median, arg_max(p, hit20) AS best_hit, count(*) AS complete FROM c WHERE failed = 0")
def rank_models(spark, sf):
    e = _predicted(spark, sf)
    c = e.groupBy("p").agg(F.count_if(F.col("predicted").isNull()).alias("failed"), (F.count_if(F.col("ape") <= 0.2) / F.count("*")).alias("hit20"))
    c = c.join(quantiles(e, ["p"], "ape", [0.5]).select("p", F.col("q0").alias("median_ape")), "p", "left")
    return c.filter("failed = 0").agg(F.min_by("p", "median_ape").alias("best_median"), F.max_by("p", "hit20").alias("best_hit"), F.count("*").alias("complete"))


_GATE = f", a AS ({_metric_sql('', 'e WHERE s = ' + chr(39) + 'O' + chr(39))}), b AS ({_metric_sql('', 'e WHERE s = ' + chr(39) + 'F' + chr(39))}), c AS ({_metric_sql('', 'e WHERE s = ' + chr(39) + 'F' + chr(39) + ' AND o_orderkey % 3 = 0')}) "


@query(_PRED + _GATE + ", checks AS (SELECT coalesce(b.median_ape <= a.median_ape - 0.01, FALSE) AS median_better, coalesce(b.hit20 >= a.hit20, FALSE) AS hit_not_lower, coalesce(b.p90_ape <= a.p90_ape, FALSE) AS p90_not_worse, coalesce(c.median_ape <= a.median_ape + 0.03, FALSE) AS frozen_not_much_worse, b.failed = 0 AS none_failed FROM a, b, c) SELECT *, CASE WHEN median_better AND hit_not_lower AND p90_not_worse AND frozen_not_much_worse AND none_failed THEN 'publish' ELSE 'retain_current' END AS release FROM checks")
def release_gate(spark, sf):
    """Open orders stand for the serving model, finished ones for the candidate, a third of these for the frozen rows."""
    e = _predicted(spark, sf)
    return M.release_gate(M.accuracy(e.filter("s = 'O'"), []), M.accuracy(e.filter("s = 'F'"), []), M.accuracy(e.filter("s = 'F' AND o_orderkey % 3 = 0"), []))


@query()
def price_model_predict(spark, sf):
    """The season price model: fitted from cell sums, then applied to every line item."""
    rows = models.priced_rows(table(spark, sf, "lineitem"))
    model = models.fit_cells(models.cells(rows))
    return models.predict(rows, model).select("l_orderkey", "l_linenumber", "season", "tier", "break_class", F.round("predicted", 2).alias("predicted"), F.round("residual", 6).alias("residual"))


@query()
def monotone_projection(spark, sf):
    """Cell medians of the season, tier and break grid, made monotone along the three axes."""
    rows = models.priced_rows(table(spark, sf, "lineitem"))
    grid = quantiles(rows, ["season", "tier", "break_class"], "y", [0.5]).withColumnRenamed("q0", "m")
    return models.project(grid)


@query()
def nested_tuning(spark, sf):
    """For each outer fold the ridge that inner folds prefer, from the cell sums of (fold, cell): one row for each fold."""
    rows = models.priced_rows(table(spark, sf, "lineitem")).withColumn("fold", F.pmod(F.xxhash64("l_suppkey"), F.lit(5)).cast("int"))
    return models.tune(rows.groupBy("fold", "season", "tier", "break_class").agg(F.count("*").alias("n"), F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("syy")))


@query()
def cross_validated_prices(spark, sf):
    """Every line item priced by the model of its supplier's fold, tuned inside the other folds."""
    rows = models.priced_rows(table(spark, sf, "lineitem")).select("l_orderkey", "l_linenumber", "l_suppkey", "season", "tier", "break_class", "y")
    out, _ = cross_validated(rows, "l_suppkey")
    return out.select("l_orderkey", "l_linenumber", F.col("outer").alias("fold"), "ridge", F.round("predicted", 2).alias("predicted"))


@query("WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) SELECT user_id, CAST((k - 1) // 4 AS BIGINT) AS chunk, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY k) AS ids FROM e GROUP BY ALL")
def chunk_rows(spark, sf):
    e = table(spark, sf, "events").withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    a = e.groupBy("user_id", F.floor((F.col("k") - 1) / 4).alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("k", "event_id"))).alias("l"))
    return a.select("user_id", "chunk", F.array_join(F.transform("l", lambda x: x["event_id"].cast("string")), ",").alias("ids"))


WIDTH, ROWS_A_PAGE, CHUNK = 60, 4, 4096


def _flow(widths: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From each state (units used of a row): each item's row after the entry row, the last row and what is used of it."""
    rows, here = np.zeros((len(widths), len(used)), np.int32), np.zeros(len(used), np.int32)
    for k, w in enumerate(widths):
        fits = used + w <= WIDTH
        here, used = np.where(fits, here, here + 1), np.where(fits, used + w, w)
        rows[k] = here
    return rows, here, used


@query()
def page_breaks(spark, sf):
    """Row layout of part names by brand: items flow into rows of WIDTH units, ROWS_A_PAGE rows a page.

    A brand is cut into chunks; what a chunk does to each of the states in which it can be entered is found on its own,
    chunk after chunk the states are followed (a row for each chunk of a brand), then each chunk is laid out."""
    p = table(spark, sf, "part").select("p_brand", "p_partkey", "p_size", F.least(F.length("p_name"), F.lit(WIDTH)).alias("w"))
    items = numbered(p, ["p_brand"], [F.col("p_size"), F.col("p_partkey"), F.col("w")], "k").withColumn("chunk", F.floor((F.col("k") - 1) / CHUNK))
    items = through_table(items, "flow-items")

    def through(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("k")
        _, more, used = _flow(rows.column("w").to_numpy(), np.arange(WIDTH + 1))
        return pa.table({"p_brand": rows.column("p_brand")[:1], "chunk": rows.column("chunk")[:1], "more": pa.array([more.tolist()], pa.list_(pa.int32())), "used": pa.array([used.tolist()], pa.list_(pa.int32()))})

    def follow(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("chunk")
        at, state, out = 0, 0, []
        for more, used in zip(rows.column("more").to_pylist(), rows.column("used").to_pylist(), strict=True):
            out.append((at, state))
            at, state = at + more[state], used[state]
        return pa.table({"p_brand": rows.column("p_brand"), "chunk": rows.column("chunk"), "row": pa.array([r for r, _ in out], pa.int64()), "state": pa.array([s for _, s in out], pa.int32())})

    def lay(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("k")
        placed, _, _ = _flow(rows.column("w").to_numpy(), rows.column("state").to_numpy()[:1])
        return pa.table({"p_brand": rows.column("p_brand"), "p_partkey": rows.column("p_partkey"), "row": pa.array(placed[:, 0] + rows.column("row").to_numpy(), pa.int32())})

    maps = items.groupBy("p_brand", "chunk").applyInArrow(through, "p_brand string, chunk long, more array<int>, used array<int>")
    entered = maps.groupBy("p_brand").applyInArrow(follow, "p_brand string, chunk long, row long, state int")
    placed = items.join(entered, ["p_brand", "chunk"]).groupBy("p_brand", "chunk").applyInArrow(lay, "p_brand string, p_partkey long, row int")
    return placed.select("p_brand", "p_partkey", "row", F.floor(F.col("row") / ROWS_A_PAGE).cast("int").alias("page"))
