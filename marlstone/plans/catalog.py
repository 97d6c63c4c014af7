"""Catalogue queries: filters, ordered reasons, tiers, custom orders and pages."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.functions import layout as Y
from marlstone.operators.filters import all_of, bounded_int, reason_cascade, rejection_counts, tier
from marlstone.operators.ranking import numbered
from marlstone.sources.tables import table

QUERIES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


#: The custom order of part types; any other comes last, as 99.
TYPE_RANK = ("PROMO", "LARGE", "MEDIUM", "SMALL", "STANDARD", "ECONOMY")
_RANK_SQL = "CASE p_type " + " ".join(f"WHEN '{t}' THEN {k}" for k, t in enumerate(TYPE_RANK)) + " ELSE 99 END"


def type_rank(c="p_type"):
    out = F.lit(99)
    for k, t in reversed(list(enumerate(TYPE_RANK))):
        out = F.when(F.col(c) == t, F.lit(k)).otherwise(out)
    return out


@query(f"SELECT p_partkey, p_type, CAST({_RANK_SQL} AS BIGINT) AS type_rank FROM part WHERE contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'ring') AND p_size <= 40 AND p_brand <> 'Brand#3'")
def catalog_filter(spark, sf):
    needle = F.contains(F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type")), F.lit("ring"))
    keep = all_of([needle, F.col("p_size") <= 40, F.col("p_brand") != "Brand#3", None])
    return table(spark, sf, "part").filter(keep).select("p_partkey", "p_type", type_rank().cast("long").alias("type_rank"))


@query("SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 'promo' WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 'own' WHEN p_size >= 40 THEN 'bulk' WHEN p_retailprice < 910 THEN 'cheap' ELSE 'other' END AS source_filter FROM part")
def case_filter(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.when(F.col("p_type") == "PROMO", "promo").when(F.col("p_brand").isin("Brand#1", "Brand#2"), "own").when(F.col("p_size") >= 40, "bulk").when(F.col("p_retailprice") < 910, "cheap").otherwise("other").alias("source_filter"))


@query("SELECT p_partkey, CASE WHEN p_size * 2 >= 100 THEN 'hundred' WHEN p_size * 2 >= 90 THEN 'many' WHEN p_size * 2 >= 60 THEN 'medium' ELSE 'few' END AS package_tier, CASE WHEN p_size * 2 >= 90 THEN 'many' WHEN p_size * 2 >= 60 THEN 'medium' ELSE 'few' END AS style_tier FROM part")
def tier_bucket(spark, sf):
    n = F.col("p_size") * 2
    return table(spark, sf, "part").select("p_partkey", tier(n, [(100, "hundred"), (90, "many"), (60, "medium")], "few").alias("package_tier"), tier(n, [(90, "many"), (60, "medium")], "few").alias("style_tier"))


_REASON_SQL = "CASE WHEN o_orderstatus = 'P' THEN 'pending' WHEN o_totalprice < 5000 THEN 'price_too_low' WHEN o_totalprice > 450000 THEN 'price_too_high' WHEN o_orderpriority = '5-LOW' THEN 'low_priority' WHEN o_orderdate > TIMESTAMP '2001-01-01' THEN 'future' WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN 'stale' END"


def _reason():
    date = F.col("o_orderdate")
    return reason_cascade([
        ("pending", F.col("o_orderstatus") == "P"), ("price_too_low", F.col("o_totalprice") < 5000), ("price_too_high", F.col("o_totalprice") > 450000),
        ("low_priority", F.col("o_orderpriority") == "5-LOW"), ("future", date > F.expr("timestamp_ntz'2001-01-01'")), ("stale", date < F.expr("timestamp_ntz'1996-01-01'")),
    ])


@query(f"SELECT o_orderkey, {_REASON_SQL} AS reason FROM orders")
def reject_reason_orders(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", _reason().alias("reason"))


@query(f"SELECT coalesce({_REASON_SQL}, 'accepted') AS reason, count(*) AS n FROM orders GROUP BY 1")
def rejection_counts_orders(spark, sf):
    return rejection_counts(table(spark, sf, "orders").select(_reason().alias("reason")))


QUERIES["rejection_counts"] = QUERIES.pop("rejection_counts_orders")


@query("SELECT doc_id, CASE WHEN text IS NULL OR text = '' THEN 'empty' WHEN length(text) < 60 THEN 'too_short' WHEN regexp_matches(lower(text), 'licen[sc]e') THEN 'notice' WHEN regexp_matches(text, '(^|[^A-Za-z])(idiot|scum|moron|trash)([^A-Za-z]|$)') THEN 'abusive' WHEN lang NOT IN ('en', 'de') THEN 'language' WHEN n_chars > 20000 THEN 'too_long' END AS reason FROM documents")
def reject_reason(spark, sf):
    t = F.col("text")
    reason = reason_cascade([
        ("empty", t.isNull() | (t == "")), ("too_short", F.length(t) < 60), ("notice", F.lower(t).rlike("licen[sc]e")),
        ("abusive", t.rlike("(^|[^A-Za-z])(idiot|scum|moron|trash)([^A-Za-z]|$)")), ("language", ~F.col("lang").isin("en", "de")), ("too_long", F.col("n_chars") > 20000),
    ])
    return table(spark, sf, "documents").select("doc_id", reason.alias("reason"))


@query("SELECT p_partkey, CASE WHEN k LIKE '%small%' OR k LIKE '%ring%' THEN 'small_goods' WHEN regexp_matches(k, 'widget|gear|bolt') AND NOT regexp_matches(k, 'promo') THEN 'hardware' WHEN regexp_matches(k, '^(red|blue|green)') THEN 'coloured' ELSE 'plain' END AS keyword_class FROM (SELECT p_partkey, lower(concat_ws(' ', p_name, p_type)) AS k FROM part)")
def keyword_class(spark, sf):
    k = F.lower(F.concat_ws(" ", "p_name", "p_type"))
    return table(spark, sf, "part").select("p_partkey", F.when(k.like("%small%") | k.like("%ring%"), "small_goods").when(k.rlike("widget|gear|bolt") & ~k.rlike("promo"), "hardware").when(k.rlike("^(red|blue|green)"), "coloured").otherwise("plain").alias("keyword_class"))


_URL_SQL = "SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) AS host, regexp_replace(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/+$', '') AS path, regexp_extract(url, '#(.*)$', 1) AS fragment, url FROM pages"


def _url(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", F.lower(F.regexp_extract(u, "^https?://([^/?#]*)", 1)).alias("host"), F.regexp_replace(F.regexp_extract(u, "^https?://[^/?#]*([^?#]*)", 1), "/+$", "").alias("path"), F.regexp_extract(u, "#(.*)$", 1).alias("fragment"), "url")


@query(f"SELECT page_id, CASE WHEN host = '' THEN NULL ELSE host || path || CASE WHEN fragment <> '' THEN '#' || fragment ELSE '' END END AS canonical_key FROM ({_URL_SQL})")
def url_canonical_key(spark, sf):
    return _url(spark, sf).select("page_id", F.when(F.col("host") != "", F.concat("host", "path", F.when(F.col("fragment") != "", F.concat(F.lit("#"), "fragment")).otherwise(""))).alias("canonical_key"))


@query(f"SELECT page_id, lower(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[a-z0-9]+$', '')) AS basename FROM ({_URL_SQL})")
def url_basename(spark, sf):
    return _url(spark, sf).select("page_id", F.lower(F.regexp_replace(F.url_decode(F.regexp_extract("path", "([^/]*)$", 1)), r"\.[a-z0-9]+$", "")).alias("basename"))


@query(f"SELECT page_id, CASE WHEN regexp_matches(host, '^(www|m)\\.') THEN 'front' WHEN starts_with(host, 'blog.') THEN 'blog' WHEN regexp_matches(host, 'casino|pills|bets|adult|spam') THEN 'spam' WHEN contains(url, 'utm_') THEN 'feed' ELSE 'plain' END AS source_kind FROM ({_URL_SQL})")
def source_kind(spark, sf):
    h = F.col("host")
    return _url(spark, sf).select("page_id", F.when(h.rlike(r"^(www|m)\."), "front").when(h.startswith("blog."), "blog").when(h.rlike("casino|pills|bets|adult|spam"), "spam").when(F.contains("url", F.lit("utm_")), "feed").otherwise("plain").alias("source_kind"))


@query("SELECT o_orderkey, raw, CASE WHEN regexp_matches(raw, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') AND try_cast(raw AS DATE) IS NOT NULL THEN raw END AS valid_day FROM (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-') || lpad(CAST(o_orderkey % 34 AS VARCHAR), 2, '0') AS raw FROM orders)")
def valid_day(spark, sf):
    raw = F.concat(F.date_format("o_orderdate", "yyyy-MM-"), F.lpad((F.col("o_orderkey") % 34).cast("string"), 2, "0"))
    day = F.try_to_date(F.col("raw"), "yyyy-MM-dd")
    return table(spark, sf, "orders").select("o_orderkey", raw.alias("raw")).withColumn("valid_day", F.when(F.date_format(day, "yyyy-MM-dd") == F.col("raw"), F.col("raw")))


@query("SELECT o_orderkey, age, CASE WHEN age < 0 THEN 'future' WHEN age <= 180 THEN 'recent180' WHEN age <= 365 THEN 'extended365' ELSE 'stale' END AS window_label FROM (SELECT o_orderkey, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-03-01') AS BIGINT) AS age FROM orders)")
def recency_window(spark, sf):
    age = F.date_diff(F.lit("2001-03-01").cast("date"), F.col("o_orderdate").cast("date")).cast("long")
    return table(spark, sf, "orders").select("o_orderkey", age.alias("age")).withColumn("window_label", F.when(F.col("age") < 0, "future").when(F.col("age") <= 180, "recent180").when(F.col("age") <= 365, "extended365").otherwise("stale"))


@query("SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-20' - INTERVAL 7 DAY AND ts <= TIMESTAMP '2024-01-20' + INTERVAL 5 MINUTE")
def ttl_filter(spark, sf):
    now = F.expr("timestamp_ntz'2024-01-20'")
    return table(spark, sf, "events").filter((F.col("ts") >= now - F.expr("interval 7 days")) & (F.col("ts") <= now + F.expr("interval 5 minutes"))).select("event_id", "user_id")


@query("SELECT o_orderkey, CASE WHEN regexp_matches(raw, '^[0-9]{1,18}$') AND try_cast(raw AS BIGINT) <= 300000 THEN try_cast(raw AS BIGINT) END AS quantity FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'x' ELSE '' END || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS raw FROM orders)")
def bounded_int_parse(spark, sf):
    raw = F.concat(F.when(F.col("o_orderkey") % 7 == 0, "x").otherwise(""), F.floor("o_totalprice").cast("string"))
    return table(spark, sf, "orders").select("o_orderkey", bounded_int(raw, 300000).alias("quantity"))


@query("SELECT count(*) AS rows_all, count(*) FILTER (strict) AS strict, count(*) FILTER (strict AND dated) AS strict_dated, count(*) FILTER (strict AND dated AND urgent) AS strict_dated_urgent, count(DISTINCT o_custkey) FILTER (strict) AS strict_accounts, count(*) FILTER (strict) >= 15 AS enough FROM (SELECT *, o_orderstatus <> 'P' AND o_totalprice > 1000 AS strict, o_orderdate >= TIMESTAMP '1998-01-01' AS dated, o_orderpriority = '1-URGENT' AS urgent FROM orders)")
def cohort_counts(spark, sf):
    o = table(spark, sf, "orders")
    strict = (F.col("o_orderstatus") != "P") & (F.col("o_totalprice") > 1000)
    dated, urgent = F.col("o_orderdate") >= F.expr("timestamp_ntz'1998-01-01'"), F.col("o_orderpriority") == "1-URGENT"
    return o.agg(F.count("*").alias("rows_all"), F.count_if(strict).alias("strict"), F.count_if(strict & dated).alias("strict_dated"), F.count_if(strict & dated & urgent).alias("strict_dated_urgent"), F.count_distinct(F.when(strict, F.col("o_custkey"))).alias("strict_accounts"), (F.count_if(strict) >= 15).alias("enough"))


@query("SELECT o_orderkey AS evidence_id, upper(substr(o_orderpriority, 3)) AS grade, CASE WHEN o_orderstatus = 'F' THEN 'sold_proxy' WHEN o_orderstatus = 'O' THEN 'ask' END AS price_kind, o_totalprice AS price, CASE WHEN o_totalprice > 0 AND o_orderstatus <> 'P' THEN 'TWD' END AS currency FROM orders")
def adapt_projection(spark, sf):
    status = F.col("o_orderstatus")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("evidence_id"), F.upper(F.substr("o_orderpriority", F.lit(3))).alias("grade"), F.when(status == "F", "sold_proxy").when(status == "O", "ask").alias("price_kind"), F.col("o_totalprice").alias("price"), F.when((F.col("o_totalprice") > 0) & (status != "P"), "TWD").alias("currency"))


@query(f"SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY {_RANK_SQL}, p_size, p_name, p_partkey) AS BIGINT) AS position FROM part")
def custom_order(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_brand", type_rank().alias("r"), "p_size", "p_name")
    return numbered(p, ["p_brand"], [F.col(c) for c in ("r", "p_size", "p_name", "p_partkey")], "position").select("p_partkey", "position")


@query(f"SELECT p_partkey, grp, CAST(cluster AS BIGINT) AS cluster, CAST(row_number() OVER (PARTITION BY grp, cluster ORDER BY {_RANK_SQL}, p_size, p_partkey) AS BIGINT) AS position FROM (SELECT *, CASE WHEN p_type = 'PROMO' THEN 'featured' WHEN p_size >= 40 THEN 'highlight' ELSE 'rest' END AS grp, CASE WHEN p_brand = 'Brand#1' THEN 1000 WHEN p_type = 'LARGE' THEN 2000 ELSE 8000 + CAST(substr(p_brand, 7) AS INTEGER) END AS cluster FROM part)")
def showcase_order(spark, sf):
    group = F.when(F.col("p_type") == "PROMO", "featured").when(F.col("p_size") >= 40, "highlight").otherwise("rest")
    cluster = F.when(F.col("p_brand") == "Brand#1", 1000).when(F.col("p_type") == "LARGE", 2000).otherwise(8000 + F.substr("p_brand", F.lit(7)).cast("int"))
    p = table(spark, sf, "part").select("p_partkey", group.alias("grp"), cluster.cast("long").alias("cluster"), type_rank().alias("r"), "p_size")
    return numbered(p, ["grp", "cluster"], [F.col(c) for c in ("r", "p_size", "p_partkey")], "position").select("p_partkey", "grp", "cluster", "position")


@query(f"SELECT p_partkey, p_name FROM part ORDER BY {_RANK_SQL}, p_size, p_name, p_partkey LIMIT 32 OFFSET 32")
def top_k_page(spark, sf):
    return table(spark, sf, "part").orderBy(type_rank(), "p_size", "p_name", "p_partkey").offset(32).limit(32).select("p_partkey", "p_name")


@query("SELECT o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next_order FROM orders")
def next_in_sequence(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("next_order"))


@query("SELECT s_suppkey, CAST(r AS BIGINT) AS grid_row, CAST(c AS BIGINT) AS grid_col, CAST(s_suppkey * 10 + c * 64 AS BIGINT) AS x, CAST(r * 64 AS BIGINT) AS y FROM supplier, range(4) a(r), range(5) b(c)")
def grid_regions(spark, sf):
    n = table(spark, sf, "supplier").withColumn("grid_row", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("grid_col", F.explode(F.sequence(F.lit(0), F.lit(4))))
    return n.select("s_suppkey", F.col("grid_row").cast("long").alias("grid_row"), F.col("grid_col").cast("long").alias("grid_col"), (F.col("s_suppkey") * 10 + F.col("grid_col") * 64).cast("long").alias("x"), (F.col("grid_row") * 64).cast("long").alias("y"))


@query()
def wrapped_names(spark, sf):
    """A customer's order priorities and years as rows of a sale text, progress rows, and its orders' boxes on pages."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.year("o_orderdate").alias("y"), F.col("o_orderpriority").alias("p"), (F.col("o_totalprice") / 4000).cast("int").alias("w"))
    one = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "y", "p", "w"))).alias("l"))  # one customer's orders
    names = F.transform("l", lambda x: F.concat(F.lower(F.substring_index(x["p"], "-", -1)), (x["y"] % 100).cast("string")))
    seasons = F.transform("l", lambda x: F.struct(x["y"].cast("string").alias("name"), (x["w"] % 4).alias("owned"), (x["w"] % 5).alias("total")))
    boxes = F.transform("l", lambda x: F.struct((x["w"] + 20).alias("w"), (x["w"] % 7 * 10 + 10).alias("h")))
    d = one.select("o_custkey", names.alias("n"), seasons.alias("s"), Y.flowed(boxes, 120, 5).alias("f"))
    ends = F.array_distinct(F.transform("f.places", lambda p: p["y"]))
    return d.select("o_custkey", F.array_join(Y.wrapped(F.col("n")), "\n").alias("names"), F.array_join(Y.progress_rows(F.col("s")), "\n").alias("progress"), F.col("f.height").alias("height"), F.size(Y.pages(ends, F.col("f.height"), 150)).alias("pages"))
