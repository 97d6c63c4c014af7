"""Market queries: what listings claim, positional and name joins, reviews, small formats."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from marlstone.functions import evidence as E
from marlstone.functions import listings as L
from marlstone.functions import text as T
from marlstone.functions.titles import SEASONS, title_claims
from marlstone.operators.alignment import anchored, resolved
from marlstone.operators.features import filled
from marlstone.operators.hierarchy import fit_lookup, fit_robust, lookup_cells, lookup_price
from marlstone.operators.models import priced_rows
from marlstone.operators.percentage import explain, fit_adjusted, sums, supported_bindings, supported_seasons
from marlstone.operators.percentage import fit as percentage_fit
from marlstone.operators.ranking import numbered
from marlstone.operators.spans import dictionary
from marlstone.sources.shared import through_table
from marlstone.sources.tables import table

QUERIES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def _planted(k, forms):
    """The kth of the forms, counted modulo their number: a claim that the row itself makes up."""
    out = None
    for n, form in enumerate(forms[:-1]):
        out = F.when(k % len(forms) == n, form) if out is None else out.when(k % len(forms) == n, form)
    return E.normalised(out.otherwise(forms[-1]))


@query("SELECT o_orderkey, CASE f WHEN 0 THEN n WHEN 1 THEN n WHEN 2 THEN n * 10 WHEN 5 THEN n END AS value, CASE f WHEN 0 THEN 'ask' WHEN 1 THEN 'quick' WHEN 2 THEN 'ask' WHEN 5 THEN 'ask' END AS kind, CASE f WHEN 3 THEN 'ambiguous_price' WHEN 4 THEN 'missing_price' END AS reason FROM (SELECT o_orderkey, o_orderkey % 6 AS f, 1000 + o_orderkey % 9000 AS n FROM orders)")
def market_price(spark, sf):
    """The price that a listing asks, and why there is none."""
    k = F.col("o_orderkey")
    n = (1000 + k % 9000).cast("string")
    forms = [F.concat(F.lit("售 "), n), F.concat(n, F.lit("秒、"), (1001 + k % 9000).cast("string"), F.lit("直")), F.concat(F.lit("價格 "), ((1000 + k % 9000) / 1000).cast("decimal(9,3)").cast("string"), F.lit("萬台")), F.concat(F.lit("售"), n, F.lit("元 或 "), (10_001 + k % 9000).cast("string"), F.lit("元")), F.concat(F.lit("白蠟 "), n, F.lit("元")), F.concat(F.lit("#售\n小王子多禮號\n"), n)]
    t = table(spark, sf, "orders").select("o_orderkey", _planted(k, forms).alias("t"))
    return t.select("o_orderkey", E.listing_price(F.col("t")).alias("p")).select("o_orderkey", "p.value", "p.kind", "p.reason")


#: For each season the first of its names, and its slug.
_SEASONS = [(words.split("|")[0].replace("?", ""), slug) for slug, words in SEASONS]


@query(f"WITH o AS (SELECT o_orderkey, o_orderkey % 6 AS f, {[s for _, s in _SEASONS]!r}[o_orderkey // 6 % {len(_SEASONS)} + 1] AS s, CAST(10 + o_orderkey % 80 AS INTEGER) AS n FROM orders) SELECT o_orderkey, CASE WHEN f IN (0, 1, 3) THEN s END AS start_season, CASE f WHEN 0 THEN 'slight' WHEN 1 THEN 'none' END AS break_class, CASE WHEN f = 1 THEN n END AS package_count, CASE f WHEN 3 THEN n WHEN 4 THEN 0 END AS packages_low, CASE f WHEN 4 THEN n END AS packages_high, CASE f WHEN 0 THEN 'few' WHEN 2 THEN 'many' END AS sale_tier, CASE f WHEN 5 THEN 'simple' END AS account_style, f = 5 AS wingless FROM o")
def market_title(spark, sf):
    """What a listing's title claims of the account."""
    k = F.col("o_orderkey")
    season = F.get(F.array(*(F.lit(name) for name, _ in _SEASONS)), F.expr(f"int((o_orderkey div 6) % {len(_SEASONS)})"))
    n = (10 + k % 80).cast("string")
    forms = [F.concat(season, F.lit("起微斷少禮號")), F.concat(season, F.lit("季起無斷"), n, F.lit("禮")), F.concat(season, F.lit("季斗篷多禮號")), F.concat(season, F.lit("已畢業"), n, F.lit("+ 個禮包")), F.concat(F.lit("不是"), season, F.lit("畢業｜最多"), n, F.lit("禮")), F.concat(season, F.lit("微斷中斷簡號 無翼"))]
    t = table(spark, sf, "orders").select("o_orderkey", _planted(k, forms).alias("t"))
    c = t.select("o_orderkey", title_claims(F.col("t")).alias("c"))
    return c.select("o_orderkey", "c.start_season", "c.break_class", "c.package_count", F.col("c.package_range.low").alias("packages_low"), F.col("c.package_range.high").alias("packages_high"), "c.sale_tier", "c.account_style", "c.wingless")


@query("SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'none' WHEN 1 THEN 'transfer' END AS complete, CASE c_custkey % 6 WHEN 2 THEN 'gameCenter=transfer,nintendo=keep' WHEN 3 THEN 'facebook=none' WHEN 4 THEN 'steam=issue' ELSE '' END AS by_platform, CASE WHEN c_custkey % 6 IN (2, 5) THEN 'google' ELSE '' END AS conflicts FROM customer")
def market_bindings(spark, sf):
    """What a listing says of the account's platform bindings: for all, for each, and where it contradicts itself."""
    forms = ["帳號無綁｜可直接改密碼", "綁全出｜售後不退", "GG、NS不出｜GG,GC可出", "FB未綁｜PSN:出 不確定", "Apple ID、NS不出｜Steam 遺失", "GG可出/不可出"]
    t = table(spark, sf, "customer").select("c_custkey", _planted(F.col("c_custkey"), [F.lit(f) for f in forms]).alias("t"))
    b = t.select("c_custkey", E.bindings(F.col("t")).alias("b"))
    by = F.array_join(F.array_sort(F.transform(F.map_entries("b.by_platform"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    return b.select("c_custkey", F.col("b.complete").alias("complete"), by.alias("by_platform"), F.array_join("b.conflicts", ",").alias("conflicts"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'candles:exact:' || n || ':' || n || ',hearts:exact:' || p_size || ':' || p_size || ',ascended:exact:9:9,passes:exact:2:2' WHEN 1 THEN 'candles:approximate:' || n || ':' || n || ',hearts:range:' || p_size || ':or more' WHEN 2 THEN 'candles:range:' || n * 10000 || ':' || (n + 1) * 10000 ELSE 'passes:exact:1:1' END AS resources, p_partkey % 4 = 0 AS complete FROM (SELECT p_partkey, p_size, p_partkey % 90 + 1 AS n FROM part)")
def market_resources(spark, sf):
    """The resources that a listing counts, exactly, about, or within bounds."""
    k = F.col("p_partkey")
    n, m, size = (k % 90 + 1).cast("string"), (k % 90 + 2).cast("string"), F.col("p_size").cast("string")
    forms = [F.concat(F.lit("白蠟 "), n, F.lit("｜"), size, F.lit("愛心｜昇華蠟 9｜副卡 2")), F.concat(F.lit("約 "), n, F.lit(" 白蠟｜愛心 "), size, F.lit("+｜紅蠟 1｜紅蠟 2")), F.concat(F.lit("白蠟 "), n, F.lit("萬～"), m, F.lit("萬｜不到 "), size, F.lit("愛心")), F.concat(F.lit("愛心眼鏡｜副卡 1｜白蠟 "), n, F.lit(" 至 約200"))]
    r = table(spark, sf, "part").select("p_partkey", "p_size", _planted(k, forms).alias("t")).select("p_partkey", E.resources(F.col("t")).alias("r"))
    said = F.transform("r", lambda x: F.concat_ws(":", x["resource"], x["kind"], x["low"].cast("string"), F.coalesce(x["high"].cast("string"), F.lit("or more"))))
    return r.select("p_partkey", F.array_join(said, ",").alias("resources"), (F.size(F.filter("r", lambda x: x["kind"] == "exact")) == len(E.RESOURCES)).alias("complete"))


_POS = "WITH r AS (SELECT p_brand AS b, p_partkey AS k, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i FROM part WHERE p_partkey % 5 <> 2), t AS (SELECT p_brand AS b, p_partkey AS k, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS j FROM part WHERE p_partkey % 7 <> 3), a AS (SELECT r.b, i, j FROM r JOIN t ON r.b = t.b AND r.k = t.k WHERE r.k % 4 = 0), n AS (SELECT b, n_i, n_j FROM (SELECT b, count(*) AS n_i FROM r GROUP BY 1) JOIN (SELECT b, count(*) AS n_j FROM t GROUP BY 1) USING (b)), e AS (SELECT b, i, j, FALSE AS z FROM a UNION ALL SELECT b, 0, 0, TRUE FROM n UNION ALL SELECT b, n_i + 1, n_j + 1, TRUE FROM n), g AS (SELECT *, lag(i) OVER w AS i0, lag(j) OVER w AS j0, lag(z) OVER w AS z0 FROM e WINDOW w AS (PARTITION BY b ORDER BY i, j)), f AS (SELECT *, unnest(range(1, i - i0)) AS d FROM g WHERE i0 IS NOT NULL AND i - i0 = j - j0 AND i - i0 - 1 BETWEEN 1 AND CASE WHEN z OR z0 THEN 8 ELSE 16 END AND b NOT IN (SELECT b FROM g WHERE i0 IS NOT NULL AND (j <= j0 OR i <= i0))) "


@query(_POS + "SELECT r.k AS row_key, t.k AS item_key FROM f JOIN r ON f.b = r.b AND r.i = f.i0 + d JOIN t ON f.b = t.b AND t.j = f.j0 + d")
def anchored_positions(spark, sf):
    """Two lists of a brand's parts, each with gaps of its own: between parts known in both, equal gaps match by place."""
    p = table(spark, sf, "part").select(F.col("p_brand").alias("b"), F.col("p_partkey").alias("k"))
    r, t = (numbered(p.filter(some), ["b"], [F.col("k")], out) for some, out in (("k % 5 <> 2", "i"), ("k % 7 <> 3", "j")))
    anchors = r.join(t, ["b", "k"]).filter("k % 4 = 0").select("b", "i", "j")
    sizes = r.groupBy("b").agg(F.count("*").alias("n_i")).join(t.groupBy("b").agg(F.count("*").alias("n_j")), "b")
    met = anchored(anchors, sizes, "b")
    return met.join(r.select("b", "i", F.col("k").alias("row_key")), ["b", "i"]).join(t.select("b", "j", F.col("k").alias("item_key")), ["b", "j"]).select("row_key", "item_key")


@query("WITH p AS (SELECT p_partkey AS k, lower(split_part(p_name, ' ', 1)) || p_size AS n, p_type AS c FROM part), cat AS (SELECT n, count(*) AS x, min(k) AS item, min(c) AS c FROM p WHERE k % 2 = 0 GROUP BY 1 HAVING count(*) = 1) SELECT p.k AS part, item FROM p JOIN cat USING (n) WHERE k % 3 <> 0 AND p.c = cat.c")
def resolve_unique_names(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("part"), F.concat(F.lower(F.substring_index("p_name", " ", 1)), F.col("p_size").cast("string")).alias("n"), F.col("p_type").alias("c"))
    return resolved(p, p.filter("part % 2 = 0").withColumnRenamed("part", "item"), p.filter("part % 3 = 0"), "part", "n", "item", "c")


@query("WITH v AS (SELECT doc_id, quality, toxic, CASE WHEN doc_id % 10 = 0 THEN 'exclude' WHEN doc_id % 10 = 3 THEN 'include' END AS decision, doc_id - doc_id % 5 AS root FROM labels), x AS (SELECT v.doc_id, v.quality, v.toxic, v.decision, r.decision AS above FROM v LEFT JOIN v r ON v.root = r.doc_id) SELECT doc_id, CASE WHEN decision = 'exclude' OR above = 'exclude' THEN 'review_excluded' WHEN decision = 'include' THEN NULL WHEN toxic = 1 THEN 'toxic' WHEN quality = 0 THEN 'low_quality' END AS reason FROM x")
def review_override(spark, sf):
    """A review's decision comes before all reasons; what excludes a root excludes what hangs on it."""
    k = F.col("doc_id")
    v = table(spark, sf, "labels").select("doc_id", "quality", "toxic", F.when(k % 10 == 0, "exclude").when(k % 10 == 3, "include").alias("decision"), (k - k % 5).alias("root"))
    roots = v.select(F.col("doc_id").alias("root"), F.col("decision").alias("above"))
    out = F.col("decision").eqNullSafe("exclude") | F.col("above").eqNullSafe("exclude")
    reason = F.when(out, "review_excluded").when(F.col("decision").eqNullSafe("include"), None).when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low_quality")
    return v.join(roots, "root", "left").select("doc_id", reason.alias("reason"))


@query("SELECT doc_id, CASE WHEN len(v) = 1 THEN v[1] END AS price, len(v) AS prices, contains(text, 'http') AS linked FROM (SELECT doc_id, text, list_sort(list_distinct(list_transform(regexp_extract_all(text, '[^0-9]([0-9]{3,6})[^0-9]', 1), lambda x: CAST(x AS BIGINT)))) AS v FROM documents)")
def single_price(spark, sf):
    """A document has a price only if it states exactly one."""
    d = table(spark, sf, "documents")
    v = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit("[^0-9]([0-9]{3,6})[^0-9]"), F.lit(1)), lambda x: x.cast("long")))
    return d.select("doc_id", "text", v.alias("v")).select("doc_id", F.when(F.size("v") == 1, F.get("v", F.lit(0))).alias("price"), F.when(F.col("v").isNotNull(), F.size("v").cast("long")).alias("prices"), F.contains("text", F.lit("http")).alias("linked"))


@query("SELECT p_partkey, round(l, 6) AS luminance, CASE WHEN l > 0.179 THEN 'dark' ELSE 'light' END AS ink FROM (SELECT p_partkey, 0.2126 * lin(p_partkey * 37 % 256) + 0.7152 * lin(p_partkey * 59 % 256) + 0.0722 * lin(p_size * 5 % 256) AS l FROM part)".replace("lin(p_partkey * 37 % 256)", "(CASE WHEN (p_partkey * 37 % 256) / 255.0 <= 0.04045 THEN (p_partkey * 37 % 256) / 255.0 / 12.92 ELSE (((p_partkey * 37 % 256) / 255.0 + 0.055) / 1.055) ** 2.4 END)").replace("lin(p_partkey * 59 % 256)", "(CASE WHEN (p_partkey * 59 % 256) / 255.0 <= 0.04045 THEN (p_partkey * 59 % 256) / 255.0 / 12.92 ELSE (((p_partkey * 59 % 256) / 255.0 + 0.055) / 1.055) ** 2.4 END)").replace("lin(p_size * 5 % 256)", "(CASE WHEN (p_size * 5 % 256) / 255.0 <= 0.04045 THEN (p_size * 5 % 256) / 255.0 / 12.92 ELSE (((p_size * 5 % 256) / 255.0 + 0.055) / 1.055) ** 2.4 END)"))
def luminance(spark, sf):
    k, s = F.col("p_partkey"), F.col("p_size")
    light = T.luminance(k * 37 % 256, k * 59 % 256, s * 5 % 256)
    return table(spark, sf, "part").select("p_partkey", F.round(light, 6).alias("luminance"), F.when(light > 0.179, "dark").otherwise("light").alias("ink"))


@query("SELECT s_suppkey, CASE WHEN regexp_matches(t, '[0-9]+(st|nd|rd|th)') THEN CAST(regexp_extract(t, '([0-9]+)(st|nd|rd|th)', 1) AS BIGINT) WHEN regexp_matches(t, '(20[0-9]{2})') AND CAST(regexp_extract(t, '(20[0-9]{2})', 1) AS BIGINT) > 2019 THEN CAST(regexp_extract(t, '(20[0-9]{2})', 1) AS BIGINT) - 2019 END AS anniversary FROM (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'the ' || (s_suppkey % 9 + 1) || 'th day' WHEN 1 THEN 'days of ' || (2010 + s_suppkey % 20) ELSE s_name END AS t FROM supplier)")
def anniversary(spark, sf):
    k = F.col("s_suppkey")
    t = F.when(k % 3 == 0, F.concat(F.lit("the "), (k % 9 + 1).cast("string"), F.lit("th day"))).when(k % 3 == 1, F.concat(F.lit("days of "), (2010 + k % 20).cast("string"))).otherwise(F.col("s_name"))
    return table(spark, sf, "supplier").select("s_suppkey", T.anniversary(t).alias("anniversary"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN whole = 0 AND f <> '' THEN f ELSE whole || f END AS label FROM (SELECT l_orderkey, l_linenumber, CAST(floor(l_quantity / 4) AS BIGINT) AS whole, CASE CAST(l_quantity AS BIGINT) % 4 WHEN 1 THEN '¼' WHEN 2 THEN '½' WHEN 3 THEN '¾' ELSE '' END AS f FROM lineitem)")
def fraction_label(spark, sf):
    q = F.col("l_quantity").cast("long")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", T.fraction(q, 4).alias("label"))


@query("WITH g AS (SELECT o_custkey AS c, o_orderpriority AS p, CASE o_orderstatus WHEN 'F' THEN 'transfer' WHEN 'O' THEN 'keep' ELSE 'issue' END AS s FROM orders), u AS (SELECT c, p, CASE WHEN count(DISTINCT s) = 1 THEN any_value(s) END AS s FROM g GROUP BY ALL) SELECT c, string_agg(p || ':' || CASE s WHEN 'transfer' THEN 'can move' WHEN 'keep' THEN 'stays' WHEN 'issue' THEN 'lost' ELSE 'unclear' END, '; ' ORDER BY p) AS bindings FROM u GROUP BY 1")
def binding_text(spark, sf):
    """One fixed wording for each binding's status, in the order of the bindings; several statuses are unclear."""
    s = F.when(F.col("o_orderstatus") == "F", "transfer").when(F.col("o_orderstatus") == "O", "keep").otherwise("issue")
    u = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c"), F.col("o_orderpriority").alias("p")).agg(F.min(s).alias("lo"), F.max(s).alias("hi"))
    words = F.when(F.col("lo") != F.col("hi"), "unclear").when(F.col("lo") == "transfer", "can move").when(F.col("lo") == "keep", "stays").otherwise("lost")
    each = u.groupBy("c").agg(F.array_sort(F.collect_list(F.concat("p", F.lit(":"), words))).alias("b"))  # a row for each priority
    return each.select("c", F.array_join("b", "; ").alias("bindings"))


@query("SELECT p_partkey, CASE WHEN p_partkey IN (7, 21, 40) THEN 'exception' WHEN starts_with(p_type, 'P') AND p_size > 10 THEN 'match' ELSE 'none' END AS sub FROM part")
def sub_with_exceptions(spark, sf):
    exception = F.col("p_partkey").isin(7, 21, 40)
    return table(spark, sf, "part").select("p_partkey", F.when(exception, "exception").when(F.col("p_type").startswith("P") & (F.col("p_size") > 10), "match").otherwise("none").alias("sub"))


@query("SELECT DISTINCT user_id AS page, regexp_extract(props, '([0-9]+)', 1) AS item FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING count(*) FILTER (event_type = 'purchase' AND value > 0) * 5 >= count(*)) AND event_type = 'click'")
def page_candidates(spark, sf):
    """Items of pages of which a fifth of the lines or more are prices, once for each page and item."""
    e = table(spark, sf, "events")
    fit = e.groupBy("user_id").agg(F.count_if((F.col("event_type") == "purchase") & (F.col("value") > 0)).alias("prices"), F.count("*").alias("lines")).filter("prices * 5 >= lines")
    return e.filter("event_type = 'click'").join(fit, "user_id", "left_semi").select(F.col("user_id").alias("page"), F.regexp_extract("props", "([0-9]+)", 1).alias("item")).distinct()


@query("WITH m AS (SELECT o_custkey AS c, list_distinct(list(year(o_orderdate))) AS seasons, min(year(o_orderdate)) FILTER (o_orderstatus = 'F') AS start, any_value(o_orderpriority ORDER BY o_orderkey) AS claim FROM orders GROUP BY 1) SELECT c, CASE WHEN start IS NULL OR len(list_filter(seasons, lambda x: x <> start)) = 0 THEN claim END AS accepted FROM m")
def claim_if_seasons_agree(spark, sf):
    """A claim counts only if every mentioned season is the start, or no start is known."""
    year = F.year("o_orderdate")
    m = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c")).agg(F.collect_set(year).alias("seasons"), F.min(F.when(F.col("o_orderstatus") == "F", year)).alias("start"), F.min_by("o_orderpriority", "o_orderkey").alias("claim"))
    return m.select("c", F.when(F.col("start").isNull() | F.forall("seasons", lambda x: x == F.col("start")), F.col("claim")).alias("accepted"))


@query()
def hierarchical_lookup(spark, sf):
    """Log prices by season, break class and tier, each season's steps pooled with the market's and its neighbours'."""
    rows, cells = lookup_cells(table(spark, sf, "lineitem"))
    return lookup_price(rows, fit_lookup(cells)).select("l_orderkey", "l_linenumber", "season", "tier", "break_class", F.round("predicted", 2).alias("predicted"))


@query()
def percentage_prices(spark, sf):
    """A season's base times break, package and resource percentages; the first season's base is known within a tenth."""
    rows = priced_rows(table(spark, sf, "lineitem")).withColumn("wax", F.col("l_tax") * 100)
    cells = through_table(sums(rows, ("wax",)), "price-sums")
    seasons, first = cells.agg(F.max("season") + 1, F.sum(F.when(F.col("season") == 0, F.col("sy"))) / F.sum(F.when(F.col("season") == 0, F.col("n")))).first()
    model = percentage_fit(cells, seasons, {0: math.exp(first)}, ("wax",), within=0.1)
    out = explain(rows.withColumn("packages", F.col("l_quantity").cast("long") * 3), model, "packages")
    return out.select("l_orderkey", "l_linenumber", *(F.round(c, 4).alias(c) for c in ("base_price", "break_factor", "package_factor", "resource_factor", "predicted")))


@query()
def adjusted_prices(spark, sf):
    """The same percentages with bindings, fitted twice: seasons that enough suppliers sold in, under several conditions, move from the reference."""
    k = F.col("l_orderkey")
    status = F.when(k % 3 == 0, "transfer").when(k % 3 == 1, "keep").otherwise("unknown")
    rows = priced_rows(table(spark, sf, "lineitem")).withColumn("wax", F.col("l_tax") * 100).withColumn("bindings", F.create_map(F.lit("google"), status, F.lit("steam"), F.when(k % 5 == 0, "issue")))
    kinds, movable = supported_bindings(rows), supported_seasons(rows, "l_suppkey")
    cells = through_table(sums(rows, ("wax",), kinds), "price-sums")
    seasons, first = cells.agg(F.max("season") + 1, F.sum(F.when(F.col("season") == 0, F.col("sy"))) / F.sum(F.when(F.col("season") == 0, F.col("n")))).first()
    model = fit_adjusted(cells, seasons, {0: math.exp(first)}, movable, ("wax",), kinds)
    out = explain(rows, model)
    return out.select("l_orderkey", "l_linenumber", *(F.round(c, 4).alias(c) for c in ("base_price", "break_factor", "package_factor", "resource_factor", "binding_factor", "predicted")))


@query()
def robust_lookup(spark, sf):
    """The pooled lookup with Student weights: prices far from their cell count little."""
    rows = through_table(priced_rows(table(spark, sf, "lineitem")).select("l_orderkey", "l_linenumber", "season", "tier", "break_class", "y"), "priced")
    return lookup_price(rows, fit_robust(rows, 4.0)).select("l_orderkey", "l_linenumber", "season", "tier", "break_class", F.round("predicted", 2).alias("predicted"))


@query("""
SELECT s_suppkey, CASE WHEN f IN (0, 2) THEN 'rhythm' WHEN f = 1 THEN 'enchantment' WHEN f = 3 THEN 'given' END AS season, CASE WHEN f IN (0, 1) THEN 'none' END AS break_class, CASE f WHEN 0 THEN 'hundred' WHEN 1 THEN 'medium' END AS package_tier,
       CASE f WHEN 0 THEN 'candles=' || s_suppkey WHEN 1 THEN 'binding:GC=不出,binding:GG=不出' WHEN 2 THEN 'progress:rhythm=0.5' WHEN 4 THEN 'accountStyle=resource,item:i' || s_nationkey || '=' || CASE WHEN s_suppkey % 2 = 0 THEN 'absent' ELSE 'present' END ELSE '' END AS features,
       CASE f WHEN 0 THEN 'season,breakClass,packageTier' WHEN 1 THEN 'season,breakClass,packageTier' WHEN 2 THEN 'season' ELSE '' END AS corrections, CASE f WHEN 4 THEN 'other' ELSE '' END AS unresolved
FROM (SELECT *, s_suppkey % 5 AS f FROM supplier)
""")
def listing_features(spark, sf):
    """What summaries state of accounts, where nothing is known: fields filled, features, and words left over."""
    k, nation = F.col("s_suppkey"), F.col("s_nationkey").cast("string")
    forms = [F.concat(F.lit("#售\n音韻無斷百禮號\n白蠟 "), k.cast("string")), F.lit("#售 #多社\n髒號\n魔法無斷中禮；GG、GC 不出"), F.lit("#售\n畢業：音韻1/2"), F.lit("音韻微斷多禮號"), F.concat(F.lit("蠟燭簡號\n◇ "), F.when(k % 2 == 0, "沒有").otherwise(""), F.lit("item "), nation, F.lit("｜other"))]
    rows = table(spark, sf, "supplier").select("s_suppkey", _planted(k, forms).alias("summary"), F.when(k % 5 == 3, "given").alias("season"), F.lit(None).cast("string").alias("break_class"), F.lit(None).cast("string").alias("package_tier"), F.when(k % 5 == 3, F.array(F.lit("breakClass"), F.lit("packageTier"))).alias("reviewed"))
    items = dictionary(table(spark, sf, "nation").select(F.concat(F.lit("item "), F.col("n_nationkey").cast("string")).alias("n"), F.concat(F.lit("i"), F.col("n_nationkey").cast("string")).alias("i")), "n", "i")
    out = filled(rows, "s_suppkey", items)
    pairs = F.array_join(F.array_sort(F.transform(F.map_entries("features"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    return out.select("s_suppkey", "season", "break_class", "package_tier", pairs.alias("features"), F.array_join(F.transform("corrections", lambda c: c["field"]), ",").alias("corrections"), F.array_join("unresolved", ",").alias("unresolved"))


@query("""
SELECT s_suppkey, CASE WHEN f = 0 THEN 2 ELSE 1 END AS offers, CASE WHEN f = 0 THEN '#代出' || chr(10) || '乙' || s_suppkey END AS second_offer, CASE f WHEN 1 THEN 'a' || chr(10) || chr(10) || 'c' END AS inventory, CASE f WHEN 1 THEN 'b' || s_suppkey END AS gifted,
       f = 2 AS data_only, CASE f WHEN 3 THEN s_suppkey * 1.0 END AS price, CASE f WHEN 3 THEN s_suppkey % 2 = 0 END AS excluded FROM (SELECT *, s_suppkey % 5 AS f FROM supplier)
""")
def listing_layout(spark, sf):
    """Numbered offers of a post, sections that aren't the account's own, offers of data alone, and marked prices."""
    k, n = F.col("s_suppkey"), F.col("s_suppkey").cast("string")
    forms = [F.concat(F.lit("#代出\n1️⃣\n甲\n2️⃣ 乙"), n), F.concat(F.lit("a\n✦ 贈號上數據\nb"), n, F.lit("\n\nc")), F.lit("僅國際服數據，無本體"), F.concat(F.lit("▍t\n♧ › "), n, F.lit(" NTD"), F.when(k % 2 == 0, "底").otherwise(""), F.lit("\n◇ ›")), F.lit("不是無本體數據")]
    t, f = table(spark, sf, "supplier").select("s_suppkey", _planted(k, forms).alias("t")), k % 5
    d = t.select("s_suppkey", L.numbered_offers(F.col("t")).alias("o"), L.inventory_sections(F.col("t")).alias("i"), L.data_only(F.col("t")).alias("data_only"), L.marked_offer(F.col("t"), F.lit("")).alias("m"))
    return d.select("s_suppkey", F.size("o").alias("offers"), F.get("o", F.lit(1)).alias("second_offer"), F.when(f == 1, F.col("i.inventory")).alias("inventory"), F.when(f == 1, F.col("i.separate_account")).alias("gifted"), "data_only", F.col("m.price").alias("price"), F.when(f == 3, F.col("m.excluded")).alias("excluded"))
