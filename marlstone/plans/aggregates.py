"""Aggregation queries: counts, spines, quantiles, shrinkage, trends."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.operators.metrics import shrunk, weighted_trend
from marlstone.operators.ranking import quantiles
from marlstone.sources.tables import table

QUERIES: dict = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = (f, sql)
        return f

    return add


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def count_by(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, count(*) FILTER (event_type = 'purchase') AS purchases, count(*) FILTER (value > 100) AS large, count(*) FILTER (value IS NULL) AS unknown, count(DISTINCT user_id) FILTER (event_type = 'error') AS users_with_errors FROM events")
def conditional_counts(spark, sf):
    return table(spark, sf, "events").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "purchase").alias("purchases"), F.count_if(F.col("value") > 100).alias("large"), F.count_if(F.col("value").isNull()).alias("unknown"), F.count_distinct(F.when(F.col("event_type") == "error", F.col("user_id"))).alias("users_with_errors"))


@query("WITH m AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '(the|and|der|die|les|que)', 1))) AS word FROM documents) SELECT word, count(*) AS documents, count(DISTINCT doc_id % 10) AS groups_seen FROM m GROUP BY 1")
def explode_counts(spark, sf):
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("(the|and|der|die|les|que)"), 1))
    m = table(spark, sf, "documents").select("doc_id", F.explode(words).alias("word"))
    return m.groupBy("word").agg(F.count("*").alias("documents"), F.count_distinct(F.col("doc_id") % 10).alias("groups_seen"))


@query("SELECT n_name, count(c_custkey) AS n FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey AND c_mktsegment = 'BUILDING' AND c_acctbal > 9500 GROUP BY 1")
def zero_filled_counts(spark, sf):
    n, c = table(spark, sf, "nation"), table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING' AND c_acctbal > 9500").groupBy("c_nationkey").agg(F.count("*").alias("c"))
    return n.join(c, n.n_nationkey == c.c_nationkey, "left").select("n_name", F.coalesce("c", F.lit(0)).alias("n"))


_SPINE = "WITH m AS (SELECT o_custkey AS cust, (year(o_orderdate) - 1995) * 4 + quarter(o_orderdate) - 1 AS s FROM orders WHERE o_orderstatus <> 'P'), st AS (SELECT cust, min(s) AS start FROM m GROUP BY 1), e AS (SELECT cust, unnest(range(start, 27)) AS s FROM st), h AS (SELECT cust, s, count(*) AS n FROM m GROUP BY ALL), sp AS (SELECT e.cust, e.s, coalesce(n, 0) AS selected FROM e LEFT JOIN h USING (cust, s)) "


def _spine(spark, sf):
    """Each customer's quarters from the first active one on, with the orders of each."""
    s = (F.year("o_orderdate") - 1995) * 4 + F.quarter("o_orderdate") - 1
    m = table(spark, sf, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_custkey").alias("cust"), s.alias("s")).groupBy("cust", "s").agg(F.count("*").alias("n"))
    e = m.groupBy("cust").agg(F.min("s").alias("start")).select("cust", F.explode(F.sequence("start", F.lit(26))).alias("s"))
    return e.join(m, ["cust", "s"], "left").select("cust", "s", F.coalesce("n", F.lit(0)).alias("selected"))


@query(_SPINE + "SELECT cust, count(*) AS expected, count(*) FILTER (selected > 0) AS selected, CAST(min(s) AS BIGINT) AS start FROM sp GROUP BY 1")
def completeness_spine(spark, sf):
    return _spine(spark, sf).groupBy("cust").agg(F.count("*").alias("expected"), F.count_if(F.col("selected") > 0).alias("selected"), F.min("s").cast("long").alias("start"))


@query(_SPINE + "SELECT cust, CASE WHEN missing = 0 THEN 'none' WHEN ratio >= 0.5 THEN 'slight' WHEN ratio >= 0.3 THEN 'medium' ELSE 'big' END AS break_class, round(ratio, 6) AS ratio FROM (SELECT cust, count(*) FILTER (selected = 0) AS missing, avg(least(1.0, selected / 1.0)) AS ratio FROM sp GROUP BY 1)")
def break_class(spark, sf):
    r = _spine(spark, sf).groupBy("cust").agg(F.count_if(F.col("selected") == 0).alias("missing"), F.avg(F.least(F.lit(1.0), F.col("selected") / 1.0)).alias("ratio"))
    q = F.col("ratio")
    return r.select("cust", F.when(F.col("missing") == 0, "none").when(q >= 0.5, "slight").when(q >= 0.3, "medium").otherwise("big").alias("break_class"), F.round(q, 6).alias("ratio"))


@query("SELECT l_returnflag, count(DISTINCT CASE WHEN l_linestatus = 'O' THEN l_partkey % 100 END) AS packages FROM lineitem WHERE l_quantity > 10 GROUP BY 1")
def distinct_derived(spark, sf):
    return table(spark, sf, "lineitem").filter("l_quantity > 10").groupBy("l_returnflag").agg(F.count_distinct(F.when(F.col("l_linestatus") == "O", F.col("l_partkey") % 100)).alias("packages"))


@query("SELECT l_partkey, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_returnflag) AS conditions, count(DISTINCT l_suppkey) >= 5 AND count(DISTINCT l_returnflag) >= 2 AS supported FROM lineitem GROUP BY 1")
def support_gate(spark, sf):
    a = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count_distinct("l_suppkey").alias("suppliers"), F.count_distinct("l_returnflag").alias("conditions"))
    return a.withColumn("supported", (F.col("suppliers") >= 5) & (F.col("conditions") >= 2))


@query("SELECT l_partkey, count(DISTINCT lower(s_name)) AS supporters FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_acctbal > 0 AND l_discount <= 0.05 GROUP BY 1 HAVING count(DISTINCT lower(s_name)) >= 2")
def supporter_gate(spark, sf):
    l, s = table(spark, sf, "lineitem").filter("l_discount <= 0.05"), table(spark, sf, "supplier").filter("s_acctbal > 0")  # noqa: E741
    return l.join(s, l.l_suppkey == s.s_suppkey).groupBy("l_partkey").agg(F.count_distinct(F.lower("s_name")).alias("supporters")).filter("supporters >= 2")


@query("SELECT l_returnflag, l_linestatus, round(quantile_cont(l_extendedprice, 0.5), 4) AS median_price FROM lineitem GROUP BY ALL")
def group_median(spark, sf):
    q = quantiles(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", [0.5])
    return q.select("l_returnflag", "l_linestatus", F.round("q0", 4).alias("median_price"))


@query("SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 4) AS q25, round(quantile_cont(l_extendedprice, 0.5), 4) AS q50, round(quantile_cont(l_extendedprice, 0.75), 4) AS q75, round(quantile_cont(l_extendedprice, 0.9), 4) AS q90 FROM lineitem GROUP BY 1")
def group_quantiles(spark, sf):
    a = quantiles(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.25, 0.5, 0.75, 0.9])
    return a.select("l_returnflag", *(F.round(f"q{k}", 4).alias(c) for k, c in enumerate(("q25", "q50", "q75", "q90"))))


_RES = "WITH g AS (SELECT l_returnflag AS flag, l_linestatus AS status, l_linenumber AS line, ln(l_extendedprice) AS y FROM lineitem WHERE l_extendedprice > 0), c AS (SELECT flag, quantile_cont(y, 0.5) AS m FROM g GROUP BY 1), r AS (SELECT g.flag, status, line, y - m AS res FROM g JOIN c USING (flag)) "


def _residuals(spark, sf):
    g = table(spark, sf, "lineitem").filter("l_extendedprice > 0").select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.col("l_linenumber").alias("line"), F.ln("l_extendedprice").alias("y"))
    c = quantiles(g, ["flag"], "y", [0.5]).select("flag", F.col("q0").alias("m"))
    return g.join(c, "flag").select("flag", "status", "line", (F.col("y") - F.col("m")).alias("res"))


@query(_RES + "SELECT flag, round(greatest(abs(quantile_cont(res, 0.25)), abs(quantile_cont(res, 0.75))), 6) AS spread FROM r GROUP BY 1")
def central_spread(spark, sf):
    a = quantiles(_residuals(spark, sf), ["flag"], "res", [0.25, 0.75])
    return a.select("flag", F.round(F.greatest(F.abs("q0"), F.abs("q1")), 6).alias("spread"))


@query(_RES + ", a AS (SELECT flag, status, line, count(*) AS n, greatest(abs(quantile_cont(res, 0.25)), abs(quantile_cont(res, 0.75))) AS s FROM r WHERE line <= 3 GROUP BY ALL), t AS (SELECT greatest(abs(quantile_cont(res, 0.25)), abs(quantile_cont(res, 0.75))) AS s FROM r) SELECT flag, status, line, n, round(CASE WHEN n < 2 THEN t.s ELSE (n * a.s + 5 * t.s) / (n + 5) END, 6) AS spread FROM a, t")
def shrunk_spread(spark, sf):
    r = _residuals(spark, sf)
    spread = F.greatest(F.abs("q0"), F.abs("q1"))
    a = quantiles(r.filter("line <= 3"), ["flag", "status", "line"], "res", [0.25, 0.75]).select("flag", "status", "line", "n", spread.alias("s"), F.lit(1).alias("one"))
    t = quantiles(r, [], "res", [0.25, 0.75]).select(spread.alias("t"), F.lit(1).alias("one"))
    j = a.join(F.broadcast(t), "one")  # one row
    return j.select("flag", "status", "line", "n", F.round(F.when(F.col("n") < 2, F.col("t")).otherwise(shrunk(F.col("s"), F.col("n"), F.col("t"), 5.0)), 6).alias("spread"))


@query("WITH m AS (SELECT (year(o_orderdate) - 1995) * 12 + month(o_orderdate) AS x, avg(ln(o_totalprice)) AS y, CAST(count(*) AS DOUBLE) AS w FROM orders WHERE o_totalprice > 0 GROUP BY 1), s AS (SELECT sum(w) AS w, sum(w * x) AS wx, sum(w * y) AS wy, sum(w * x * y) AS wxy, sum(w * x * x) AS wxx FROM m) SELECT round((wxy - wx * wy / w) / (wxx - wx * wx / w), 6) AS slope, round((wy - (wxy - wx * wy / w) / (wxx - wx * wx / w) * wx) / w, 6) AS intercept FROM s", "weighted_trend")
def q_weighted_trend(spark, sf):
    x = ((F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate")).cast("double")
    m = table(spark, sf, "orders").filter("o_totalprice > 0").groupBy(x.alias("x")).agg(F.avg(F.ln("o_totalprice")).alias("y"), F.count("*").cast("double").alias("w"))
    slope, intercept = weighted_trend(F.col("x"), F.col("y"), F.col("w"))
    return m.agg(F.round(slope, 6).alias("slope"), F.round(intercept, 6).alias("intercept"))


@query(_RES + "SELECT flag, status, count(*) AS n, round(quantile_cont(res, 0.5) * count(*) / (count(*) + 3), 6) AS residual FROM r GROUP BY ALL")
def cell_residual(spark, sf):
    a = quantiles(_residuals(spark, sf), ["flag", "status"], "res", [0.5])
    return a.select("flag", "status", "n", F.round(F.col("q0") * F.col("n") / (F.col("n") + 3), 6).alias("residual"))


@query(_RES + ", f AS (SELECT quantile_cont(res, 0.5) AS f FROM r WHERE line > 2) SELECT line, count(*) AS n, round((quantile_cont(res, 0.5) * count(*) + any_value(f) * 8) / (count(*) + 8), 6) AS residual FROM r, f GROUP BY 1")
def pooled_residual(spark, sf):
    r = _residuals(spark, sf)
    fallback = quantiles(r.filter("line > 2"), [], "res", [0.5]).select(F.col("q0").alias("f"), F.lit(1).alias("one"))
    a = quantiles(r, ["line"], "res", [0.5]).withColumn("one", F.lit(1)).join(F.broadcast(fallback), "one")  # one row
    return a.select("line", "n", F.round(shrunk(F.col("q0"), F.col("n"), F.col("f"), 8.0), 6).alias("residual"))


@query("WITH k AS (SELECT event_type || ':' || CAST(user_id % 20 AS VARCHAR) AS key FROM events WHERE value IS NOT NULL) SELECT key, n FROM (SELECT key, count(*) AS n FROM k GROUP BY 1 HAVING count(*) >= 5) ORDER BY n DESC, key LIMIT 40")
def feature_select(spark, sf):
    k = table(spark, sf, "events").filter("value IS NOT NULL").select(F.explode(F.map_keys(F.create_map(F.concat_ws(":", "event_type", (F.col("user_id") % 20).cast("string")), F.lit(1)))).alias("key"))
    return k.groupBy("key").agg(F.count("*").alias("n")).filter("n >= 5").orderBy(F.desc("n"), "key").limit(40)


@query("SELECT l_partkey, l_suppkey, n, CAST(alternatives AS BIGINT) AS alternatives FROM (SELECT l_partkey, l_suppkey, n, row_number() OVER (PARTITION BY l_partkey ORDER BY n, price, l_suppkey) AS r, count(*) OVER (PARTITION BY l_partkey) - 1 AS alternatives FROM (SELECT l_partkey, l_suppkey, count(*) AS n, min(l_extendedprice) AS price FROM lineitem GROUP BY ALL)) WHERE r = 1")
def offer_rank(spark, sf):
    o = table(spark, sf, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"), F.min("l_extendedprice").alias("price"))
    w = Window.partitionBy("l_partkey")
    return o.withColumn("r", F.row_number().over(w.orderBy("n", "price", "l_suppkey"))).withColumn("alternatives", F.count("*").over(w) - 1).filter("r = 1").select("l_partkey", "l_suppkey", "n", "alternatives")


@query("SELECT p_name, p_brand, array_to_string(list_sort(list(DISTINCT p_type)), ',') AS types, count(*) AS members FROM part GROUP BY ALL HAVING count(DISTINCT p_type) > 1")
def signature_conflicts(spark, sf):
    a = table(spark, sf, "part").groupBy("p_name", "p_brand").agg(F.collect_set("p_type").alias("t"), F.count("*").alias("members"))
    return a.filter(F.size("t") > 1).select("p_name", "p_brand", F.array_join(F.array_sort("t"), ",").alias("types"), "members")


@query("WITH c AS (SELECT p_brand, p_name, count(*) AS n FROM part GROUP BY ALL), u AS (SELECT p_name, count(DISTINCT p_brand) AS owners FROM part GROUP BY 1) SELECT p_brand, p_name AS term, owners FROM (SELECT c.*, owners, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, length(p_name), p_name) AS r FROM c JOIN u USING (p_name)) WHERE r = 1")
def preferred_term(spark, sf):
    p = table(spark, sf, "part")
    c = p.groupBy("p_brand", "p_name").agg(F.count("*").alias("n"))
    owners = c.groupBy("p_name").agg(F.count("*").alias("owners"))
    w = Window.partitionBy("p_brand").orderBy(F.desc("n"), F.length("p_name"), "p_name")
    return c.withColumn("r", F.row_number().over(w)).filter("r = 1").join(owners, "p_name").select("p_brand", F.col("p_name").alias("term"), "owners")


@query("WITH a AS (SELECT p_partkey, p_name, p_brand || ' ' || p_name AS q, count(*) OVER (PARTITION BY p_name) AS n FROM part), b AS (SELECT *, count(*) OVER (PARTITION BY q) AS m FROM a) SELECT p_partkey, CASE WHEN n = 1 THEN p_name WHEN m = 1 AND length(q) <= 20 THEN q ELSE p_name || ' #' || CAST(p_partkey AS VARCHAR) END AS label FROM b")
def collision_qualify(spark, sf):
    a = table(spark, sf, "part").withColumn("q", F.concat_ws(" ", "p_brand", "p_name")).withColumn("n", F.count("*").over(Window.partitionBy("p_name")))
    b = a.withColumn("m", F.count("*").over(Window.partitionBy("q")))
    return b.select("p_partkey", F.when(F.col("n") == 1, F.col("p_name")).when((F.col("m") == 1) & (F.length("q") <= 20), F.col("q")).otherwise(F.concat("p_name", F.lit(" #"), F.col("p_partkey").cast("string"))).alias("label"))


@query("WITH d AS (SELECT user_id, CAST(ts AS DATE) AS d FROM events GROUP BY ALL), b AS (SELECT user_id, min(d) AS first_day, max(d) AS last_day, count(*) AS days FROM d GROUP BY 1) SELECT user_id, CAST(date_diff('day', first_day, last_day) + 1 - days AS BIGINT) AS gaps, days, date_diff('day', last_day, DATE '2024-01-30') <= 10 AS fresh, CASE WHEN date_diff('day', first_day, last_day) + 1 = days THEN 'complete' WHEN days >= 10 THEN 'gappy' ELSE 'sparse' END AS health FROM b")
def sequence_gap_health(spark, sf):
    d = table(spark, sf, "events").select("user_id", F.col("ts").cast("date").alias("d")).distinct()
    b = d.groupBy("user_id").agg(F.min("d").alias("a"), F.max("d").alias("z"), F.count("*").alias("days"))
    gaps = F.date_diff("z", "a") + 1 - F.col("days")
    return b.select("user_id", gaps.cast("long").alias("gaps"), "days", (F.date_diff(F.lit("2024-01-30").cast("date"), F.col("z")) <= 10).alias("fresh"), F.when(gaps == 0, "complete").when(F.col("days") >= 10, "gappy").otherwise("sparse").alias("health"))


@query("SELECT count(*) AS n, count(*) FILTER (c_mktsegment IS NULL) AS no_segment, count(*) FILTER (b IS NULL) AS no_balance, count(*) FILTER (b IS NULL AND c_nationkey < 5) AS no_balance_known_nation FROM (SELECT *, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS b FROM customer)")
def null_counts(spark, sf):
    b = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).isNull()
    return table(spark, sf, "customer").agg(F.count("*").alias("n"), F.count_if(F.col("c_mktsegment").isNull()).alias("no_segment"), F.count_if(b).alias("no_balance"), F.count_if(b & (F.col("c_nationkey") < 5)).alias("no_balance_known_nation"))


@query("WITH g AS (SELECT CAST(p_size // 10 AS BIGINT) AS s, p_type, quantile_cont(p_retailprice, 0.5) AS m FROM part GROUP BY ALL), a AS (SELECT *, lag(m) OVER (PARTITION BY p_type ORDER BY s) AS by_size, lag(m) OVER (PARTITION BY s ORDER BY p_type) AS by_type FROM g) SELECT count(*) AS cells, count(*) FILTER (m < by_size) AS size_reversals, count(*) FILTER (m < by_type) AS type_reversals FROM a")
def monotone_violations(spark, sf):
    g = quantiles(table(spark, sf, "part").withColumn("s", F.floor(F.col("p_size") / 10)), ["s", "p_type"], "p_retailprice", [0.5]).select("s", "p_type", F.col("q0").alias("m"))
    a = g.withColumn("by_size", F.lag("m").over(Window.partitionBy("p_type").orderBy("s"))).withColumn("by_type", F.lag("m").over(Window.partitionBy("s").orderBy("p_type")))
    return a.agg(F.count("*").alias("cells"), F.count_if(F.col("m") < F.col("by_size")).alias("size_reversals"), F.count_if(F.col("m") < F.col("by_type")).alias("type_reversals"))
