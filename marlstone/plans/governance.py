"""Governance queries: patches, import classes, digests, diffs, uniqueness, and small value operations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.operators import ledgers as L
from marlstone.sources.tables import table

QUERIES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


@query("WITH pa AS (SELECT p_partkey, 'size' AS field, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'nowhere' END AS quote, 7 AS value, count(*) OVER (PARTITION BY p_partkey) AS c FROM part WHERE p_partkey % 5 = 0), t AS (SELECT p.p_partkey, CASE WHEN p.p_partkey % 10 = 0 THEN NULL ELSE p_size END AS size, p_name || ' ' || p_brand AS txt, quote, value, c FROM part p LEFT JOIN pa USING (p_partkey)) SELECT p_partkey, CASE WHEN size IS NULL AND contains(txt, quote) AND c = 1 THEN value ELSE size END AS size, CASE WHEN quote IS NULL THEN 'none' WHEN NOT contains(txt, quote) THEN 'quote_missing' WHEN size IS NOT NULL THEN 'already_known' ELSE 'applied' END AS patch FROM t")
def apply_patches(spark, sf):
    p = table(spark, sf, "part")
    patches = p.filter("p_partkey % 5 = 0").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise("nowhere").alias("quote"), F.lit(7).alias("value"))
    patches = patches.withColumn("c", F.count("*").over(Window.partitionBy("p_partkey")))
    t = p.select("p_partkey", F.when(F.col("p_partkey") % 10 != 0, F.col("p_size")).alias("size"), F.concat_ws(" ", "p_name", "p_brand").alias("txt")).join(patches, "p_partkey", "left")
    quoted = F.contains("txt", "quote")
    return t.select("p_partkey", F.when(F.col("size").isNull() & quoted & (F.col("c") == 1), F.col("value")).otherwise(F.col("size")).alias("size"), F.when(F.col("quote").isNull(), "none").when(~quoted, "quote_missing").when(F.col("size").isNotNull(), "already_known").otherwise("applied").alias("patch"))


@query("WITH e AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'bad id' WHEN event_id % 7 = 0 THEN 'old-' || CAST(user_id AS VARCHAR) ELSE CAST(user_id AS VARCHAR) END AS raw FROM events), m AS (SELECT event_id, raw, CASE WHEN starts_with(raw, 'old-') THEN substr(raw, 5) ELSE raw END AS id FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY event_id) AS rn FROM m) SELECT event_id, CASE WHEN NOT regexp_matches(id, '^[0-9]+$') THEN 'invalid' WHEN CAST(try_cast(id AS BIGINT) AS BIGINT) > 140 THEN 'unknown' WHEN rn > 1 THEN 'duplicate' WHEN raw <> id THEN 'migrated' ELSE 'imported' END AS import_class FROM r")
def import_classify(spark, sf):
    user = F.col("user_id").cast("string")
    raw = F.when(F.col("event_id") % 11 == 0, "bad id").when(F.col("event_id") % 7 == 0, F.concat(F.lit("old-"), user)).otherwise(user)
    m = table(spark, sf, "events").select("event_id", raw.alias("raw")).withColumn("id", F.when(F.col("raw").startswith("old-"), F.substr("raw", F.lit(5))).otherwise(F.col("raw")))
    # Only whether an earlier row has the id matters, so the first place is aggregated where the rows lie.
    first = m.groupBy("id").agg(F.min("event_id").alias("first"))
    r = m.join(first, "id").withColumn("rn", F.when(F.col("event_id") > F.col("first"), 2).otherwise(1))
    return r.select("event_id", F.when(~F.col("id").rlike("^[0-9]+$"), "invalid").when(F.col("id").try_cast("long") > 140, "unknown").when(F.col("rn") > 1, "duplicate").when(F.col("raw") != F.col("id"), "migrated").otherwise("imported").alias("import_class"))


@query("SELECT c_custkey, coalesce(new_id, c_custkey) AS id, new_id IS NOT NULL AS migrated FROM customer LEFT JOIN (VALUES (1, 1001), (5, 1005), (9, 1009)) a(old_id, new_id) ON c_custkey = old_id")
def legacy_id_migrate(spark, sf):
    names = F.create_map(*(F.lit(x).cast("long") for pair in ((1, 1001), (5, 1005), (9, 1009)) for x in pair))
    new = F.try_element_at(names, F.col("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey", F.coalesce(new, "c_custkey").alias("id"), new.isNotNull().alias("migrated"))


_SNAP = "WITH old AS (SELECT s_suppkey, s_name, s_nationkey FROM supplier WHERE s_suppkey % 10 <> 3), new AS (SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN upper(s_name) ELSE s_name END AS s_name, s_nationkey FROM supplier WHERE s_suppkey % 10 <> 4) "


def _snapshots(spark, sf):
    s = table(spark, sf, "supplier")
    return s.filter("s_suppkey % 10 <> 3").select("s_suppkey", "s_name", "s_nationkey"), s.filter("s_suppkey % 10 <> 4").select("s_suppkey", F.when(F.col("s_suppkey") % 7 == 0, F.upper("s_name")).otherwise(F.col("s_name")).alias("s_name"), "s_nationkey")


@query(_SNAP + "SELECT 'removed' AS side, * FROM (SELECT * FROM old EXCEPT ALL SELECT * FROM new) UNION ALL SELECT 'added', * FROM (SELECT * FROM new EXCEPT ALL SELECT * FROM old)")
def snapshot_diff(spark, sf):
    old, new = _snapshots(spark, sf)
    side = lambda d, s: d.select(F.lit(s).alias("side"), "*")
    return side(old.exceptAll(new), "removed").union(side(new.exceptAll(old), "added"))


@query(_SNAP + "SELECT (SELECT count(*) FROM old) AS old_count, (SELECT count(*) FROM new) AS new_count, (SELECT count(*) FROM new) >= (SELECT count(*) FROM old) AS may_write")
def shrink_guard(spark, sf):
    old, new = _snapshots(spark, sf)
    j = old.agg(F.count("*").alias("old_count")).withColumn("one", F.lit(1)).join(new.agg(F.count("*").alias("new_count")).withColumn("one", F.lit(1)), "one")
    return j.select("old_count", "new_count", (F.col("new_count") >= F.col("old_count")).alias("may_write"))


_TREE = ", ".join(f"l{k} AS (SELECT seg, substr(p, 1, {k}) AS p, sum(n) AS n, sha256(string_agg(h, ',' ORDER BY h)) AS h FROM {'r' if k == 8 else f'l{k + 2}'} GROUP BY ALL)" for k in (8, 6, 4, 2, 0))


@query(f"WITH r AS (SELECT seg, h, h AS p, 1 AS n FROM (SELECT c_mktsegment AS seg, sha256(concat_ws('|', CAST(c_custkey AS VARCHAR), c_name, CAST(c_nationkey AS VARCHAR))) AS h FROM customer)), {_TREE} SELECT seg, CAST(n AS BIGINT) AS n, h AS digest FROM l0")
def dataset_digest(spark, sf):
    """A tree of digests: row hashes by their first eight digits, then two digits less a level, so that a node has 256
    children at most and a leaf few rows at any size."""
    h = F.sha2(F.concat_ws("|", F.col("c_custkey").cast("string"), "c_name", F.col("c_nationkey").cast("string")), 256)
    level = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("seg"), h.alias("h"), h.alias("p"), F.lit(1).cast("long").alias("n"))
    for digits in (8, 6, 4, 2, 0):
        level = level.groupBy("seg", F.substring("p", 1, digits).alias("p")).agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ","), 256).alias("h"))
    return level.select("seg", "n", F.col("h").alias("digest"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def uniqueness_check(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("copies")).filter("copies > 1")


@query("SELECT event_id, CAST(regexp_extract(props, '\"k\": ([0-9]+)', 1) AS BIGINT) AS k, CAST(regexp_extract(props, '\"k\": ([0-9]+)', 1) AS BIGINT) % 10 AS bucket FROM events")
def json_props_extract(spark, sf):
    k = F.from_json("props", "k long")["k"]
    return table(spark, sf, "events").select("event_id", k.alias("k"), (k % 10).alias("bucket"))


@query("WITH a AS (SELECT o_custkey, list(o_orderpriority ORDER BY o_orderkey) AS l FROM orders GROUP BY 1) SELECT o_custkey, CAST(len(list_distinct(l)) AS BIGINT) AS distinct_count, list_contains(l, '1-URGENT') AS any_urgent, len(list_filter(l, lambda x: x >= '3')) = len(l) AS all_low, l[1] AS first_seen FROM a")
def array_ops(spark, sf):
    a = table(spark, sf, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))), lambda x: x["o_orderpriority"]).alias("l"))
    return a.select("o_custkey", F.size(F.array_distinct("l")).cast("long").alias("distinct_count"), F.array_contains("l", "1-URGENT").alias("any_urgent"), F.forall("l", lambda x: x >= "3").alias("all_low"), F.get("l", F.lit(0)).alias("first_seen"))


@query("WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, count(*) FILTER (n >= 13) AS frequent, CAST(sum(CASE WHEN event_type LIKE '%s%' THEN n ELSE 0 END) AS BIGINT) AS s_events, max(n) FILTER (event_type = 'click') AS clicks FROM c GROUP BY 1")
def map_ops(spark, sf):
    c = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    frequent, s = F.map_filter("m", lambda k, v: v >= 13), F.map_values(F.map_filter("m", lambda k, v: k.like("%s%")))
    return c.select("user_id", F.size(frequent).cast("long").alias("frequent"), F.aggregate(s, F.lit(0).cast("long"), lambda a, v: a + v).alias("s_events"), F.try_element_at("m", F.lit("click")).alias("clicks"))


@query("WITH c AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL) SELECT n_name, n_name || ': ' || string_agg(c_mktsegment || ' ' || CAST(n AS VARCHAR), ', ' ORDER BY c_mktsegment) AS report FROM nation JOIN c ON n_nationkey = c_nationkey GROUP BY 1")
def report_text(spark, sf):
    c = table(spark, sf, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    a = c.groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.concat_ws(" ", "c_mktsegment", F.col("n").cast("string")))).alias("l"))
    n = table(spark, sf, "nation")
    return n.join(a, n.n_nationkey == a.c_nationkey).select("n_name", F.concat("n_name", F.lit(": "), F.array_join("l", ", ")).alias("report"))


@query("WITH r AS (SELECT p_partkey, CAST(p_partkey % 1500 AS VARCHAR) || '|' || p_name || '|' || CASE p_partkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE 'X' END || '|' || p_type || '|' || p_brand AS line FROM part), f AS (SELECT p_partkey, string_split(line, '|') AS f FROM r), c AS (SELECT *, count(*) OVER (PARTITION BY f[1]) AS n FROM f) SELECT p_partkey, f[1] AS id, CASE WHEN len(f) <> 5 THEN 'field_count' WHEN f[3] NOT IN ('A', 'B', 'C') THEN 'grade' WHEN n > 1 THEN 'duplicate_id' END AS problem FROM c")
def delimited_validate(spark, sf):
    k = F.col("p_partkey")
    line = F.concat_ws("|", (k % 1500).cast("string"), "p_name", F.when(k % 4 == 0, "A").when(k % 4 == 1, "B").when(k % 4 == 2, "C").otherwise("X"), "p_type", "p_brand")
    f = table(spark, sf, "part").select("p_partkey", F.split(line, "[|]").alias("f")).withColumn("id", F.col("f")[0])
    c = f.withColumn("n", F.count("*").over(Window.partitionBy("id")))
    return c.select("p_partkey", "id", F.when(F.size("f") != 5, "field_count").when(~F.col("f")[2].isin("A", "B", "C"), "grade").when(F.col("n") > 1, "duplicate_id").alias("problem"))


_RESULTS = "'applied', 'source_digest_mismatch', 'quote_not_found', 'reason_required', 'only_exclusions_may_be_added', 'invalid_feature', 'already_known_or_reviewed', 'duplicate_patch', 'applied', 'missing_or_duplicate_row', 'already_known_or_reviewed'"


@query(f"SELECT p_partkey, copy, [{_RESULTS}][p_partkey % 11 + 1] AS result FROM part, range(CAST(CASE p_partkey % 11 WHEN 7 THEN 2 ELSE 1 END AS BIGINT)) t(copy)")
def reviewed_patches(spark, sf):
    """A patch for each part, each with one thing wrong or none."""
    k = F.col("p_partkey")
    f = k % 11
    p = table(spark, sf, "part")
    rows = p.filter(f != 9).select(k.cast("string").alias("post_key"), F.concat("p_name", F.lit(" "), "p_brand").alias("summary"), F.when(f == 10, F.array(F.lit("season"))).alias("reviewed_fields"), F.when(f == 6, "rhythm").alias("season"))
    at = lambda n, other, good: F.when(f == n, other).otherwise(good)
    patches = p.select("p_partkey", F.explode(F.sequence(F.lit(0).cast("long"), F.when(f == 7, 1).otherwise(0).cast("long"))).alias("copy"), k.cast("string").alias("post_key"), F.when(f.isin(4, 8), "exclude_from_model").otherwise("season").alias("field"), F.when(f == 4, "false").when(f == 8, "true").when(f == 5, "winter").otherwise("rhythm").alias("value"), at(2, "nowhere", F.col("p_brand")).alias("quote"), at(3, " ", F.lit("seen")).alias("reason"), at(1, "old", F.lit("d1")).alias("source_digest"))
    return L.reviewed_patches(rows, patches, "d1", {"season": ("rhythm", "flight")}).select("p_partkey", "copy", "result")


@query("WITH d AS (SELECT user_id, event_id, CASE event_type WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN 3 END AS k, ts FROM events WHERE event_id % 5 <> 0 AND ts >= TIMESTAMP '2024-01-25' - INTERVAL 30 DAY AND ts <= TIMESTAMP '2024-01-25' + INTERVAL 5 MINUTE) SELECT user_id, CAST(count(*) > 0 AS BOOLEAN) AS found, min(k) > 1 AS moved FROM d WHERE k IS NOT NULL GROUP BY 1")
def newest_drafts(spark, sf):
    """A user's draft: under the first of three keys that has one which is readable and fresh."""
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type", "ts")
    d = L.newest_drafts(e, "user_id", "event_type", ("purchase", "click", "view"), "ts", F.expr("timestamp_ntz'2024-01-25'"), F.col("event_id") % 5 != 0)
    return d.select("user_id", F.lit(True).alias("found"), "moved")


@query("SELECT 'query' AS how, p_partkey FROM part WHERE p_size <= 40 AND contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'ring') AND p_type <> 'SMALL' UNION ALL SELECT 'tab', p_partkey FROM part WHERE p_type = 'PROMO' AND p_size > 45 AND p_type <> 'SMALL'")
def catalog_search(spark, sf):
    """A query searches all closets and no tab, a blank one keeps to the tab; the source filter holds for both."""
    p, source = table(spark, sf, "part"), F.col("p_type") != "SMALL"
    tab, closet = (F.col("p_type") == "PROMO") & (F.col("p_size") > 45), F.col("p_size") <= 40
    found = lambda q, how: L.searched(p, q, tab, closet, ["p_name", "p_brand", "p_type"], source, None).select(F.lit(how).alias("how"), "p_partkey")
    return found("  RING ", "query").unionByName(found("   ", "tab"))


@query("WITH n AS (SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 'x套組' WHEN p_partkey % 2 = 0 THEN 'n' || p_partkey ELSE p_name END AS term, ['A', 'B', 'C'][p_partkey % 3 + 1] AS grade FROM part), c AS (SELECT term, count(*) AS n FROM n GROUP BY 1) SELECT p_partkey, CASE WHEN grade <> 'C' AND length(term) BETWEEN 2 AND 12 AND NOT contains(term, '套組') AND n = 1 THEN term END AS shown, CASE WHEN grade <> 'C' AND length(term) BETWEEN 2 AND 6 THEN term END AS for_sale FROM n JOIN c USING (term)")
def shown_names(spark, sf):
    """Names that may stand for their items, on display and in sale texts."""
    k = F.col("p_partkey")
    names = table(spark, sf, "part").select("p_partkey", F.when(k % 9 == 0, "x套組").when(k % 2 == 0, F.concat(F.lit("n"), k.cast("string"))).otherwise(F.col("p_name")).alias("term"), F.get(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (k % 3).cast("int")).alias("grade"))
    return L.shown_names(names, "term", "grade").select("p_partkey", "shown", "for_sale")


@query("SELECT c_custkey, CAST((c_custkey % 4 = 0)::INT + (c_custkey % 3 = 1)::INT AS BIGINT) AS locked FROM customer")
def locked_bindings(spark, sf):
    """How many bindings of an account are known to be locked."""
    k = F.col("c_custkey")
    features = F.create_map(F.lit("binding:GG"), F.when(k % 4 == 0, "不出").otherwise("transferable"), F.lit("binding:NS"), F.when(k % 3 == 1, "issue").when(k % 3 == 2, "unbound"), F.lit("candles"), F.lit("9"))
    return table(spark, sf, "customer").select("c_custkey", L.locked(features).cast("long").alias("locked"))
