"""Queries whose result depends on an order: history, gaps, survivors, folds; and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.operators.history import change_history as changes
from marlstone.operators.history import interpolate
from marlstone.operators.history import snapshot_merge as merge
from marlstone.operators.ranking import numbered
from marlstone.sources.tables import table

QUERIES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


@query("WITH e AS (SELECT *, CAST(ts AS DATE) AS snap, event_id % 3 <> 0 AS complete, CASE WHEN event_id % 4 <> 0 THEN props END AS note, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) SELECT user_id, event_type, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen, count(DISTINCT snap) AS observation_count, bool_or(complete) AS seen_in_complete_snapshot, bool_or(complete) FILTER (rn = 1) AS latest_snapshot_complete, max(value) FILTER (rn = 1) AS value, arg_min(note, rn) FILTER (note IS NOT NULL) AS note FROM e GROUP BY ALL")
def snapshot_merge(spark, sf):
    """Daily snapshots of (user, event type): the newest row's value, null or not; the latest note there is."""
    e = table(spark, sf, "events").withColumn("note", F.when(F.col("event_id") % 4 != 0, F.col("props")))
    m = merge(e, ["user_id", "event_type"], "ts", "event_id", F.col("ts").cast("date"), F.col("event_id") % 3 != 0, ["value"], ["note"])
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return m.select("user_id", "event_type", stamp("first_seen_at").alias("first_seen"), stamp("last_seen_at").alias("last_seen"), "observation_count", "seen_in_complete_snapshot", "latest_snapshot_complete", "value", "note")


@query("WITH v AS (SELECT event_id, user_id, event_type, floor(value / 10) AS v, CASE WHEN event_id % 7 = 0 THEN 'USD' WHEN event_id % 11 > 0 THEN 'TWD' END AS currency, ts FROM events), p AS (SELECT *, lag(v) OVER w AS prev, lag(currency) OVER w AS prev_currency, row_number() OVER w AS rn FROM v WHERE v IS NOT NULL AND currency IS NOT NULL WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)), k AS (SELECT *, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM p WHERE rn = 1 OR v <> prev OR currency <> prev_currency) SELECT event_id, user_id, event_type, CAST(v AS BIGINT) AS level, currency FROM k WHERE n > 1")
def change_history(spark, sf):
    k = F.col("event_id")
    e = table(spark, sf, "events").withColumn("v", F.floor(F.col("value") / 10)).withColumn("currency", F.when(k % 7 == 0, "USD").when(k % 11 > 0, "TWD"))
    return changes(e, ["user_id", "event_type"], "ts", "event_id", ["v", "currency"]).select("event_id", "user_id", "event_type", F.col("v").alias("level"), "currency")


_MONTHLY = "WITH m AS (SELECT o_orderpriority AS p, (year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS x, avg(o_totalprice) AS y FROM orders GROUP BY ALL), g AS (SELECT p, CAST(x AS BIGINT) AS x, CASE WHEN x % 4 IN (1, 2) AND x > 3 OR x > 70 OR x < 2 THEN NULL ELSE y END AS y FROM m) "


def _monthly(spark, sf):
    x = ((F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate") - 1).cast("long")
    m = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("p"), x.alias("x")).agg(F.avg("o_totalprice").alias("y"))
    return m.withColumn("y", F.when(((F.col("x") % 4).isin(1, 2) & (F.col("x") > 3)) | (F.col("x") > 70) | (F.col("x") < 2), None).otherwise(F.col("y")))


@query(_MONTHLY + ", s AS (SELECT *, max(CASE WHEN y IS NOT NULL THEN x END) OVER (PARTITION BY p ORDER BY x) AS px, min(CASE WHEN y IS NOT NULL THEN x END) OVER (PARTITION BY p ORDER BY x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nx FROM g), a AS (SELECT p, list({'x': x, 'y': y} ORDER BY x) AS o FROM g WHERE y IS NOT NULL GROUP BY 1) SELECT s.p, s.x, round(CASE WHEN s.y IS NOT NULL THEN s.y WHEN px IS NOT NULL AND nx IS NOT NULL THEN b.y + (c.y - b.y) * (s.x - px) / (nx - px) WHEN px IS NOT NULL THEN o[-2].y + (o[-1].y - o[-2].y) * (s.x - o[-2].x) / (o[-1].x - o[-2].x) ELSE o[1].y + (o[2].y - o[1].y) * (s.x - o[1].x) / (o[2].x - o[1].x) END, 4) AS filled FROM s JOIN a USING (p) LEFT JOIN g b ON b.p = s.p AND b.x = px LEFT JOIN g c ON c.p = s.p AND c.x = nx")
def interpolate_gaps(spark, sf):
    return interpolate(_monthly(spark, sf), ["p"], "x", "y").select("p", "x", F.round("filled", 4).alias("filled"))


@query(_MONTHLY + "SELECT p, x, round(min(y) OVER (PARTITION BY p ORDER BY x ROWS UNBOUNDED PRECEDING), 4) AS envelope FROM g")
def running_min(spark, sf):
    w = Window.partitionBy("p").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    return _monthly(spark, sf).select("p", "x", F.round(F.min("y").over(w), 4).alias("envelope"))


@query("WITH a AS (SELECT *, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-01') AS BIGINT) AS age FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT *, count(*) FILTER (age <= 400) OVER (PARTITION BY o_custkey) AS recent FROM a) SELECT o_orderkey, age, recent FROM b WHERE age <= 400 OR (age <= 800 AND recent < 2)")
def sparse_cohort_extend(spark, sf):
    age = F.date_diff(F.lit("2001-08-01").cast("date"), F.col("o_orderdate").cast("date")).cast("long")
    a = table(spark, sf, "orders").filter("o_orderstatus = 'F'").withColumn("age", age)
    b = a.withColumn("recent", F.count_if(F.col("age") <= 400).over(Window.partitionBy("o_custkey")))
    return b.filter("age <= 400 OR (age <= 800 AND recent < 2)").select("o_orderkey", "age", "recent")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def latest_per_identity(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")
    return table(spark, sf, "orders").withColumn("r", F.row_number().over(w)).filter("r = 1").select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT u.key, u.event_id, f.pos FROM (SELECT key, arg_max(event_id, event_id) AS event_id, min(event_id) AS pos FROM (SELECT event_id, user_id || '|' || event_type AS key FROM events) GROUP BY 1) u JOIN (SELECT user_id || '|' || event_type AS key, min(event_id) AS pos FROM events GROUP BY 1) f USING (key)")
def unique_last_wins(spark, sf):
    e = table(spark, sf, "events").withColumn("key", F.concat_ws("|", F.col("user_id").cast("string"), "event_type"))
    return e.groupBy("key").agg(F.max("event_id").alias("event_id"), F.min("event_id").alias("pos"))


@query("WITH a AS (SELECT event_id, value, 'purchase' AS origin, NULL AS k FROM events WHERE event_type = 'purchase' UNION ALL SELECT event_id, NULL, 'click', CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) FROM events WHERE event_type = 'click') SELECT * FROM a")
def union_sources(spark, sf):
    e = table(spark, sf, "events")
    a = e.filter("event_type = 'purchase'").select("event_id", "value", F.lit("purchase").alias("origin"))
    b = e.filter("event_type = 'click'").select("event_id", F.lit("click").alias("origin"), F.regexp_extract("props", "([0-9]+)", 1).cast("long").alias("k"))
    return a.unionByName(b, allowMissingColumns=True)


@query("SELECT user_id FROM events WHERE event_type = 'view' AND value > 50 EXCEPT SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 80")
def except_rows(spark, sf):
    e = table(spark, sf, "events")
    return e.filter("event_type = 'view' AND value > 50").select("user_id").subtract(e.filter("event_type = 'purchase' AND value > 80").select("user_id"))


@query("WITH h AS (SELECT o_custkey AS c, list_sort(list(DISTINCT o_orderpriority)) AS have FROM orders GROUP BY 1), f AS (SELECT c, have, ['1-URGENT', '2-HIGH', '3-MEDIUM'] AS preset FROM h) SELECT c, array_to_string(list_sort(CASE WHEN list_has_all(have, preset) THEN list_filter(have, lambda x: NOT list_contains(preset, x)) ELSE list_distinct(list_concat(have, preset)) END), ',') AS after FROM f")
def set_toggle(spark, sf):
    preset = F.array(F.lit("1-URGENT"), F.lit("2-HIGH"), F.lit("3-MEDIUM"))
    h = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c")).agg(F.collect_set("o_orderpriority").alias("have"))
    whole = F.size(F.array_except(preset, "have")) == 0
    return h.select("c", F.array_join(F.array_sort(F.when(whole, F.array_except("have", preset)).otherwise(F.array_union("have", preset))), ",").alias("after"))


@query("WITH o AS (SELECT p_partkey, upper(p_name) AS p_name FROM part WHERE p_partkey % 13 = 0) SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM o) UNION ALL SELECT * FROM o")
def override_union(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name")
    o = p.filter("p_partkey % 13 = 0").select("p_partkey", F.upper("p_name").alias("p_name"))
    return p.join(o.select("p_partkey"), "p_partkey", "left_anti").unionByName(o)


@query("SELECT DISTINCT l_returnflag, l_linestatus, l_discount FROM lineitem")
def distinct_rows(spark, sf):
    return table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_discount").distinct()


_FOLD = "(('0x' || substr(sha256(concat('market-benchmark-v1:', CAST(c_custkey AS VARCHAR))), 1, 8))::BIGINT % 5)"


def _fold(key="c_custkey"):
    return F.conv(F.substring(F.sha2(F.concat(F.lit("market-benchmark-v1:"), F.col(key).cast("string")), 256), 1, 8), 16, 10).cast("long") % 5


@query("SELECT c_custkey, sha256(concat('market-benchmark-v1:', CAST(c_custkey AS VARCHAR))) AS key_hash FROM customer")
def hash_key(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.sha2(F.concat(F.lit("market-benchmark-v1:"), F.col("c_custkey").cast("string")), 256).alias("key_hash"))


@query("SELECT c_custkey, CAST((row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256(CAST(c_custkey AS VARCHAR)), c_custkey) - 1) % 5 AS BIGINT) AS fold FROM customer")
def fixed_folds(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", F.sha2(F.col("c_custkey").cast("string"), 256).alias("h"))
    return numbered(c, ["c_mktsegment"], [F.col("h"), F.col("c_custkey")], "k").select("c_custkey", ((F.col("k") - 1) % 5).alias("fold"))


@query(f"SELECT c_custkey, {_FOLD} AS fold FROM customer")
def hash_folds(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", _fold().alias("fold"))


@query(f"WITH old AS (SELECT c_custkey, CAST(c_custkey % 5 AS BIGINT) AS fold FROM customer WHERE c_custkey % 3 = 0) SELECT c.c_custkey, coalesce(old.fold, {_FOLD.replace('c_custkey', 'c.c_custkey')}) AS fold FROM customer c LEFT JOIN old USING (c_custkey)")
def frozen_folds(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey")
    old = c.filter("c_custkey % 3 = 0").select("c_custkey", (F.col("c_custkey") % 5).alias("old"))
    return c.join(old, "c_custkey", "left").select("c_custkey", F.coalesce("old", _fold()).alias("fold"))


@query(f"WITH f AS (SELECT c_nationkey, {_FOLD} AS fold FROM customer) SELECT CAST(fold AS BIGINT) AS fold, count(DISTINCT c_nationkey) FILTER (c_nationkey IN (SELECT c_nationkey FROM f g WHERE g.fold <> f.fold)) AS shared_groups FROM f GROUP BY 1")
def leakage_check(spark, sf):
    f = table(spark, sf, "customer").select("c_nationkey", _fold().alias("fold")).distinct()
    wide = f.groupBy("c_nationkey").agg(F.count("*").alias("folds"))
    return f.join(wide, "c_nationkey").groupBy("fold").agg(F.count_if(F.col("folds") > 1).alias("shared_groups"))


@query("WITH r AS (SELECT o_orderdate, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders), c AS (SELECT max(o_orderdate) AS cut FROM r WHERE i = CAST(floor(0.8 * n) AS BIGINT)) SELECT o_orderkey, CASE WHEN o_orderdate < cut THEN 'train' ELSE 'test' END AS part FROM orders, c")
def time_split(spark, sf):
    o = table(spark, sf, "orders")
    n = o.count()
    # The cut is the first date up to which more than floor(0.8 n) rows lie: days are counted, rows aren't sorted.
    days = o.groupBy("o_orderdate").agg(F.count("*").alias("c"))
    upto = days.withColumn("s", F.sum("c").over(Window.orderBy("o_orderdate")))  # one row for each date
    cut = upto.filter(F.col("s") > int(0.8 * n)).agg(F.min("o_orderdate").alias("cut")).withColumn("one", F.lit(1))
    j = o.withColumn("one", F.lit(1)).join(F.broadcast(cut), "one")
    return j.select("o_orderkey", F.when(F.col("o_orderdate") < F.col("cut"), "train").otherwise("test").alias("part"))
