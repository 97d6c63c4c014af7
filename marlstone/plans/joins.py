"""Join queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.operators.joins import asof_join as asof
from marlstone.operators.joins import cascade_lookup as cascade
from marlstone.operators.joins import longest_contained, nearest
from marlstone.operators.joins import field_diff as diff
from marlstone.sources.tables import table

QUERIES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


@query("SELECT n_name, p_type, count(*) AS n, round(avg(l_extendedprice), 4) AS avg_price FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL")
def dim_join(spark, sf):
    l, p, s, n = (table(spark, sf, t) for t in ("lineitem", "part", "supplier", "nation"))  # noqa: E741
    j = l.join(p, l.l_partkey == p.p_partkey).join(s, l.l_suppkey == s.s_suppkey).join(n, s.s_nationkey == n.n_nationkey)
    return j.groupBy("n_name", "p_type").agg(F.count("*").alias("n"), F.round(F.avg("l_extendedprice"), 4).alias("avg_price"))


@query("SELECT c_custkey, coalesce(s_name, n_name, r_name) AS label FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey < 20 LEFT JOIN region ON c_nationkey % 5 = r_regionkey")
def cascade_lookup(spark, sf):
    c = table(spark, sf, "customer").withColumn("r", F.col("c_nationkey") % 5)
    steps = [(table(spark, sf, "supplier"), "c_custkey", "s_suppkey", "s_name"), (table(spark, sf, "nation").filter("n_nationkey < 20"), "c_nationkey", "n_nationkey", "n_name"), (table(spark, sf, "region"), "r", "r_regionkey", "r_name")]
    return cascade(c, steps, "label").select("c_custkey", "label")


@query("SELECT s_suppkey, coalesce(nullif(CASE WHEN s_acctbal > 9000 THEN s_name END, ''), CASE WHEN s_nationkey % 2 = 0 THEN n_name END, r_name, 'unknown') AS display_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def name_priority(spark, sf):
    s, n, r = (table(spark, sf, t) for t in ("supplier", "nation", "region"))
    j = s.join(n, s.s_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left")
    return j.select("s_suppkey", F.coalesce(F.nullif(F.when(F.col("s_acctbal") > 9000, F.col("s_name")), F.lit("")), F.when(F.col("s_nationkey") % 2 == 0, F.col("n_name")), "r_name", F.lit("unknown")).alias("display_name"))


@query("SELECT c.c_custkey, coalesce(d.seg, c.c_mktsegment) AS segment, coalesce(d.bal, c.c_acctbal) AS balance FROM customer c LEFT JOIN (SELECT o_custkey, CASE WHEN max(o_totalprice) > 400000 THEN 'KEY' END AS seg, CASE WHEN count(*) > 12 THEN max(o_totalprice) END AS bal FROM orders GROUP BY 1) d ON c.c_custkey = d.o_custkey")
def enrich_override(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    d = o.groupBy("o_custkey").agg(F.when(F.max("o_totalprice") > 400000, "KEY").alias("seg"), F.when(F.count("*") > 12, F.max("o_totalprice")).alias("bal"))
    return c.join(d, c.c_custkey == d.o_custkey, "left").select("c_custkey", F.coalesce("seg", "c_mktsegment").alias("segment"), F.coalesce("bal", "c_acctbal").alias("balance"))


@query("SELECT p.event_id, p.user_id, r.value AS rate FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view' AND value IS NOT NULL) r ON p.user_id = r.user_id AND p.ts >= r.ts")
def asof_join(spark, sf):
    e = table(spark, sf, "events")
    out = asof(e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts"), e.filter("event_type = 'view'").select("user_id", "ts", "value"), ["user_id"], "ts", "value")
    return out.select("event_id", "user_id", F.col("asof_value").alias("rate"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def semi_join(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders").filter("o_totalprice > 300000")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def anti_join(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey", "c_name")


@query("WITH b AS (SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN upper(p_name) ELSE p_name END AS p_name, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size END AS p_size, p_type FROM part), u AS (SELECT a.p_partkey, unnest([{'field': 'p_name', 'before': a.p_name, 'after': b.p_name}, {'field': 'p_size', 'before': a.p_size::VARCHAR, 'after': b.p_size::VARCHAR}, {'field': 'p_type', 'before': a.p_type, 'after': b.p_type}], recursive := true) FROM part a JOIN b USING (p_partkey)) SELECT p_partkey, field, before, after FROM u WHERE before IS DISTINCT FROM after")
def field_diff(spark, sf):
    a = table(spark, sf, "part")
    b = a.select("p_partkey", F.when(F.col("p_partkey") % 11 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("p_name"), F.when(F.col("p_partkey") % 7 != 0, F.col("p_size")).alias("p_size"), "p_type")
    return diff(a, b, "p_partkey", ["p_name", "p_size", "p_type"])


@query("WITH k AS (SELECT regexp_replace(lower(p_name), '[^a-z]', '', 'g') AS k, p_partkey, p_brand FROM part WHERE p_size <= 25), c AS (SELECT k, count(DISTINCT p_brand) AS brands, min(p_partkey) AS first_part FROM k GROUP BY 1), q AS (SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z]', '', 'g') AS k FROM part WHERE p_size > 25) SELECT q.p_partkey, CASE WHEN brands IS NULL THEN 'missing' WHEN brands = 1 THEN 'matched' ELSE 'ambiguous' END AS status, coalesce(brands, 0) AS candidates, CASE WHEN brands = 1 THEN first_part END AS match FROM q LEFT JOIN c USING (k)")
def asset_match_status(spark, sf):
    p = table(spark, sf, "part").withColumn("k", F.regexp_replace(F.lower("p_name"), "[^a-z]", ""))
    c = p.filter("p_size <= 25").groupBy("k").agg(F.count_distinct("p_brand").alias("brands"), F.min("p_partkey").alias("first_part"))
    j = p.filter("p_size > 25").join(c, "k", "left")
    return j.select("p_partkey", F.when(F.col("brands").isNull(), "missing").when(F.col("brands") == 1, "matched").otherwise("ambiguous").alias("status"), F.coalesce("brands", F.lit(0)).alias("candidates"), F.when(F.col("brands") == 1, F.col("first_part")).alias("match"))


@query("WITH h AS (SELECT doc_id, item_id, length(b.text) AS alias_length, rank() OVER (PARTITION BY doc_id ORDER BY length(b.text) DESC) AS r FROM documents d JOIN benchmark b ON contains(d.text, b.text) AND length(b.text) > 0) SELECT doc_id, item_id, CAST(alias_length AS BIGINT) AS alias_length FROM h WHERE r = 1")
def contains_longest(spark, sf):
    out = longest_contained(table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "benchmark"), "item_id", "text")
    return out.withColumn("alias_length", F.col("alias_length").cast("long"))


_KNN = "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL), s AS (SELECT q.vec_id, r.vec_id AS ref_id, round(list_cosine_similarity(q.e, r.e), 9) AS score FROM v q JOIN v r ON q.vec_id % 20 = 0 AND q.vec_id <> r.vec_id), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, ref_id) AS rk, lead(score) OVER (PARTITION BY vec_id ORDER BY score DESC, ref_id) AS second FROM s) "


def _nearest(spark, sf, k):
    """Vectors whose id is divisible by 20 against all others."""
    return nearest(table(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0, k).withColumnsRenamed({"query": "vec_id", "ref": "ref_id"})


@query(_KNN + "SELECT vec_id, ref_id, round(score, 6) AS score, round(score - second, 6) AS margin, CASE WHEN score < 0.3 THEN 'weak' WHEN score - second < 0.03 THEN 'ambiguous' ELSE 'matched' END AS status FROM k WHERE rk = 1")
def knn_margin(spark, sf):
    two = _nearest(spark, sf, 2).withColumn("second", F.lead("score").over(Window.partitionBy("vec_id").orderBy("rank")))
    s, d = F.col("score"), F.col("score") - F.col("second")
    return two.filter("rank = 1").select("vec_id", "ref_id", F.round(s, 6).alias("score"), F.round(d, 6).alias("margin"), F.when(s < 0.3, "weak").when(d < 0.03, "ambiguous").otherwise("matched").alias("status"))


@query(_KNN + "SELECT vec_id, CAST(rk AS BIGINT) AS rank, ref_id, round(score, 6) AS score FROM k WHERE rk <= 3")
def knn_topk(spark, sf):
    return _nearest(spark, sf, 3).select("vec_id", F.col("rank").cast("long").alias("rank"), "ref_id", F.round("score", 6).alias("score"))


@query("WITH iv(name, lo, hi) AS (VALUES ('early', 0, 20), ('middle', 18, 45), ('late', 60, 70)), m AS (SELECT o_orderkey, (year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS mi FROM orders) SELECT o_orderkey, coalesce(name, 'late') AS page FROM m LEFT JOIN iv ON mi < hi AND mi + 1 > lo")
def interval_overlap(spark, sf):
    intervals = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(a).alias("lo"), F.lit(b).alias("hi")) for n, a, b in (("early", 0, 20), ("middle", 18, 45), ("late", 60, 70))))
    mi = (F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate") - 1
    hits = F.filter(intervals, lambda i: (F.col("mi") < i["hi"]) & (F.col("mi") + 1 > i["lo"]))
    o = table(spark, sf, "orders").select("o_orderkey", mi.alias("mi")).select("o_orderkey", F.transform(hits, lambda i: i["name"]).alias("names"))
    return o.select("o_orderkey", F.explode(F.when(F.size("names") > 0, F.col("names")).otherwise(F.array(F.lit("late")))).alias("page"))


@query("SELECT r_name, p_type, brk, round(CAST(r_regionkey * 100 + len(p_type) * 10 + brk AS DOUBLE), 4) AS probe FROM region JOIN (SELECT DISTINCT p_type FROM part) ON true JOIN (VALUES (0), (1), (2), (3)) b(brk) ON true")
def probe_grid(spark, sf):
    r = table(spark, sf, "region").withColumn("k", F.lit(1))
    types = table(spark, sf, "part").select("p_type").distinct().withColumn("k", F.lit(1))
    g = r.join(F.broadcast(types), "k").withColumn("brk", F.explode(F.sequence(F.lit(0), F.lit(3))))  # as many rows as part types
    return g.select("r_name", "p_type", "brk", F.round((F.col("r_regionkey") * 100 + F.length("p_type") * 10 + F.col("brk")).cast("double"), 4).alias("probe"))


@query("WITH s AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS ps FROM orders GROUP BY 1), k AS (SELECT array_to_string(ps, ',') AS sig, o_custkey FROM s) SELECT sig, count(*) AS members, min(o_custkey) AS first_member FROM k GROUP BY 1 HAVING count(*) > 1")
def set_equality(spark, sf):
    s = table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("sig"))
    return s.groupBy("sig").agg(F.count("*").alias("members"), F.min("o_custkey").alias("first_member")).filter("members > 1")


@query("WITH pre(preset, brand) AS (VALUES ('starter', 'Brand#1'), ('starter', 'Brand#2'), ('pro', 'Brand#3')), m AS (SELECT preset, p_partkey FROM pre JOIN part ON brand = p_brand UNION SELECT 'all_promo', p_partkey FROM part WHERE p_type = 'PROMO') SELECT preset, p_partkey FROM m")
def preset_join(spark, sf):
    p = table(spark, sf, "part")
    preset = F.when(F.col("p_brand").isin("Brand#1", "Brand#2"), "starter").when(F.col("p_brand") == "Brand#3", "pro")
    by_name = p.select(preset.alias("preset"), "p_partkey").filter("preset IS NOT NULL")
    return by_name.union(p.filter("p_type = 'PROMO'").select(F.lit("all_promo").alias("preset"), "p_partkey")).distinct()


@query("WITH m AS (SELECT p_brand, p_partkey FROM part WHERE p_type = 'PROMO'), o AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity >= 49) SELECT p_brand, count(*) AS expected, count(l_partkey) AS selected, count(l_partkey) = count(*) AS complete, count(l_partkey) BETWEEN 1 AND count(*) - 1 AS partial FROM m LEFT JOIN o ON p_partkey = l_partkey GROUP BY 1")
def preset_state(spark, sf):
    m = table(spark, sf, "part").filter("p_type = 'PROMO'").select("p_brand", "p_partkey")
    o = table(spark, sf, "lineitem").filter("l_quantity >= 49").select("l_partkey").distinct()
    n, s = F.count("*"), F.count("l_partkey")
    return m.join(o, m.p_partkey == o.l_partkey, "left").groupBy("p_brand").agg(n.alias("expected"), s.alias("selected"), (s == n).alias("complete"), s.between(1, n - 1).alias("partial"))


@query("WITH old AS (SELECT p_partkey, p_name, [p_brand] AS aliases FROM part WHERE p_partkey % 2 = 0), new AS (SELECT p_partkey, upper(p_name) AS p_name, p_brand, p_type FROM part WHERE p_partkey % 3 = 0) SELECT coalesce(old.p_partkey, new.p_partkey) AS p_partkey, coalesce(old.p_name, new.p_name) AS name, array_to_string(list_sort(list_distinct(list_concat(coalesce(old.aliases, []), CASE WHEN new.p_partkey IS NOT NULL THEN [new.p_type] ELSE [] END))), ',') AS aliases FROM old FULL JOIN new USING (p_partkey)")
def upsert_priority(spark, sf):
    p = table(spark, sf, "part")
    old = p.filter("p_partkey % 2 = 0").select("p_partkey", F.col("p_name").alias("old_name"), F.array("p_brand").alias("old"))
    new = p.filter("p_partkey % 3 = 0").select("p_partkey", F.upper("p_name").alias("new_name"), F.array("p_type").alias("new"))
    none = F.array().cast("array<string>")
    return old.join(new, "p_partkey", "full").select("p_partkey", F.coalesce("old_name", "new_name").alias("name"), F.array_join(F.array_sort(F.array_union(F.coalesce("old", none), F.coalesce("new", none))), ",").alias("aliases"))


@query("SELECT t.c_custkey, t.grp FROM (SELECT c_custkey, c_nationkey AS grp FROM customer WHERE c_mktsegment <> 'BUILDING') t WHERE NOT EXISTS (SELECT 1 FROM customer s WHERE s.c_mktsegment = 'BUILDING' AND s.c_acctbal > 8000 AND s.c_nationkey = t.grp)")
def leave_source_out(spark, sf):
    c = table(spark, sf, "customer")
    test = c.filter("c_mktsegment = 'BUILDING' AND c_acctbal > 8000").select(F.col("c_nationkey").alias("g")).distinct()
    train = c.filter("c_mktsegment <> 'BUILDING'").select("c_custkey", F.col("c_nationkey").alias("grp"))
    return train.join(test, F.col("grp") == F.col("g"), "left_anti")
