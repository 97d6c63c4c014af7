"""Scan queries: catalog names in texts, masks, pages and nested records, over texts that the rows make up."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import masks, spans
from marlstone.sources import gifts, pages
from marlstone.sources.records import named_records as read_records
from marlstone.sources.tables import table

QUERIES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


_GROUP = "setofbrand7"


@query(f"""
WITH n AS (SELECT count(*) AS n FROM part), c AS (SELECT p_partkey AS k, replace(p_name, ' ', '') || 'no' || p_partkey AS name, lower('setof' || replace(p_brand, '#', '#')) AS b FROM part),
b AS (SELECT replace(b, '#', '#') AS b, count(*) AS items, min(k) AS one FROM c GROUP BY 1),
o AS (SELECT o_orderkey, o_orderkey % n + 1 AS x, o_orderkey * 7 % n + 1 AS y, o_orderkey * 13 % n + 1 AS z FROM orders, n),
t AS (SELECT o_orderkey, x, z, cy.name AS gone, b.b AS brand, b.items, b.one FROM o JOIN c cx ON cx.k = x JOIN c cy ON cy.k = y JOIN c cz ON cz.k = z JOIN b ON b.b = cx.b),
l AS (SELECT o_orderkey, gone, list_sort(list_distinct(list_concat([x, z], CASE WHEN items = 1 THEN [one] ELSE [] END))) AS matched, CASE WHEN items > 1 THEN replace(brand, '#', '#') END AS several FROM t)
SELECT o_orderkey, array_to_string(matched, ',') AS matched, gone AS excluded, CASE WHEN replace(several, '#', '') <> '{_GROUP}' THEN several END AS ambiguous, CASE WHEN replace(several, '#', '') = '{_GROUP}' THEN several END AS groups, 'nothingatall' AS unmatched FROM l
""")
def catalog_spans(spark, sf):
    """Part names in an order's text, alone, inside other words, and said to be missing; a brand's name stands for all its parts."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.concat("p_name", F.lit(" no "), F.col("p_partkey").cast("string")).alias("name"), F.concat(F.lit("set of "), "p_brand").alias("brand"))
    known = spans.single(p.select("name", "k").unionByName(p.select(F.col("brand").alias("name"), "k")), "name", "k")
    n = p.count()
    name = lambda c: p.select(F.col("k").alias(c), F.col("name").alias(f"{c}_name"), F.col("brand").alias(f"{c}_brand"))
    o = table(spark, sf, "orders").select("o_orderkey", *(F.expr(f"cast(o_orderkey * {f} % {n} + 1 as bigint)").alias(c) for f, c in ((1, "x"), (7, "y"), (13, "z"))))
    o = o.join(name("x"), "x").join(name("y"), "y").join(name("z"), "z")
    text = o.select("o_orderkey", F.concat("x_name", F.lit("｜沒有"), "y_name", F.lit("、Xx"), "z_name", F.lit("yy | "), "x_brand", F.lit("| nothing at all")).alias("text"))
    brands = p.select("brand").distinct().select(spans.form(F.col("brand")).alias("term")).distinct()
    groups = tuple(r["term"] for r in brands.filter(F.replace("term", F.lit("#")) == _GROUP).collect())  # one name
    found = spans.resolved(spans.spans(text, "o_orderkey", "text", known, groups))
    of = lambda route: F.nullif(F.array_join(F.array_sort(F.collect_list(F.when(F.col("route") == route, F.col("thing")))), ","), F.lit(""))
    matched = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("route") == "matched", F.col("thing").cast("long")))), lambda k: k.cast("string")), ",")
    return found.groupBy(F.col("id").alias("o_orderkey")).agg(matched.alias("matched"), of("excluded").alias("excluded"), of("ambiguous").alias("ambiguous"), of("group").alias("groups"), of("unmatched").alias("unmatched"))


@query("""
WITH m AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END) AS b FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL)) = 0),
s AS (SELECT vec_id, CAST(array_to_string(list_transform(range(64), lambda p: CASE WHEN p // 8 - dy BETWEEN 0 AND 7 AND p % 8 - dx BETWEEN 0 AND 7 THEN b[(p // 8 - dy) * 8 + p % 8 - dx + 1] ELSE '0' END), '') AS BIT) AS m FROM m, range(-4, 5) y(dy), range(-4, 5) x(dx)),
q AS (SELECT vec_id, CAST(array_to_string(b, '') AS BIT) AS m FROM m WHERE vec_id % 20 = 0),
p AS (SELECT q.vec_id AS query, s.vec_id AS ref, round(max(CASE WHEN bit_count(q.m | s.m) > 0 THEN bit_count(q.m & s.m) / bit_count(q.m | s.m) ELSE 0 END), 9) AS score FROM q JOIN s ON q.vec_id <> s.vec_id GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, ref) AS k FROM p)
SELECT query, max(ref) FILTER (k = 1) AS ref, max(score) FILTER (k = 1) AS score, round(max(score) FILTER (k = 1) - coalesce(max(score) FILTER (k = 2), 0), 9) AS margin,
       CASE WHEN max(score) FILTER (k = 1) >= 0.93 AND round(max(score) FILTER (k = 1) - coalesce(max(score) FILTER (k = 2), 0), 9) >= 0.03 THEN 'accepted' ELSE 'review' END AS status
FROM r WHERE k <= 2 GROUP BY 1
""")
def mask_overlap(spark, sf):
    """The reference mask that each query mask overlaps most under shifts of up to four places, if it is clearly the best."""
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x > 0).alias("m"))
    return masks.classified(masks.best_overlaps(e, F.col("vec_id") % 20 == 0, "vec_id", "m", 8))


@query("SELECT s_suppkey, place, CAST(s_suppkey * 3 + place AS VARCHAR) AS listing_id, s_name || ' & co ' || place AS title, CASE place WHEN 2 THEN s_suppkey * 1000 + 234.5 ELSE s_suppkey + 0.5 END::DOUBLE AS price, CASE place WHEN 1 THEN 'EUR' ELSE 'USD' END AS currency FROM supplier, range(1, 3) t(place) WHERE s_suppkey % 5 <> 0 OR place <> 2")
def html_listings(spark, sf):
    """A page's listings: id from the link's query, price from the machine's attribute or else the shown text; without either none."""
    k = F.col("s_suppkey")
    item = lambda href, price: F.concat(F.lit('<a class="tc-item big" href="'), href, F.lit('"><div class="tc-desc"><div class="tc-desc-text">'), F.col("s_name"), F.lit(" &amp;  co "))
    first = F.concat(item(F.concat(F.lit("/lots/offer?x=1&amp;id="), (k * 3 + 1).cast("string")), None), F.lit('1</div></div><div class="tc-price" data-s="'), k.cast("string"), F.lit('.5"><div>€ 9</div></div></a>'))
    second = F.concat(item(F.when(k % 5 == 0, "/lots/offer?idx=9").otherwise(F.concat(F.lit("/lots/offer?id="), (k * 3 + 2).cast("string"))), None), F.lit('2</div></div><div class="tc-price"><div>$ '), k.cast("string"), F.lit(".234,50</div><div>$ 1</div></div></a>"))
    third = F.lit('<a class="tc-item" href="?id=1"><div class="tc-desc-text">free</div><div class="tc-price"><div>ask</div></div></a><!-- <a class="tc-item" href="?id=2"></a> -->')
    html = table(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit("<html><body><div class=list>"), first, second, third, F.lit("</div></body></html>")).alias("html"))
    rows = pages.html_rows(html, "s_suppkey", "html", "a.tc-item", {"href": "@href", "title": ".tc-desc-text", "machine": ".tc-price@data-s", "shown": ".tc-price div"})
    shown = pages.shown_text(F.col("shown"))
    price = F.coalesce(F.get("machine", F.lit(0)).try_cast("double"), T.localized_number(F.nullif(F.regexp_extract(shown, "([0-9.,]+)", 1), F.lit(""))))
    currency = F.when(shown.contains("$"), "USD").when(shown.contains("₽"), "RUB").otherwise("EUR")
    told = rows.select("s_suppkey", F.col("place").cast("long").alias("place"), pages.query_value(F.get("href", F.lit(0)), "id").alias("listing_id"), pages.shown_text(F.col("title")).alias("title"), price.alias("price"), currency.alias("currency"))
    return told.filter("listing_id IS NOT NULL AND price IS NOT NULL")


@query("""
WITH p AS (SELECT s_suppkey AS k, s_suppkey % 6 AS f FROM supplier)
SELECT k AS page, CASE WHEN f < 5 THEN 1 END AS place, CASE f WHEN 0 THEN 'exact-members' WHEN 1 THEN 'review-package-members' WHEN 2 THEN 'exact-members' WHEN 3 THEN 'unknown-member' WHEN 4 THEN 'unknown-member' END AS status,
       CASE f WHEN 0 THEN 'pair' WHEN 2 THEN 'solo' END AS package_key, CASE f WHEN 2 THEN 'c' END AS name_item, CASE WHEN f < 5 THEN 'TWD:' || (k + 100) || ',VND:' || (k * 1000) END AS prices, CASE WHEN f = 5 THEN 'incomplete' END AS reason FROM p
""")
def gift_pages(spark, sf):
    """Gift pages: their packages, whether their members are one known package, and the prices shown; a page whose declared count is wrong is refused."""
    k = F.col("s_suppkey")
    icons = [["A", "B"], ["A"], ["C"], ["Z"], [], ["A"]]
    pics = F.get(F.array(*(F.lit("".join(f'<img alt="{i}">' for i in x)) for x in icons)), (k % 6).cast("int"))
    html = F.concat(F.lit('<p>5</p><div id="gc"> '), F.when(k % 6 == 5, "2").otherwise("1"), F.lit(' </div><div id="gl"><div class="g-item"><div class="nm">'), F.when(k % 6 == 2, "單件").otherwise("套裝"), F.lit('</div><div class="pr">NT$'), (k + 100).cast("string"), F.lit("<span>₫"), (k * 1000).cast("string"), F.lit('</span></div><div class="g-unlocks">'), pics, F.lit("</div></div></div>"))
    rows = gifts.gift_packages(table(spark, sf, "supplier").select(k.cast("string").alias("page"), html.alias("html")))
    known = spark.createDataFrame([("A", "a"), ("B", "b"), ("C", "c")], "icon string, guid string")
    catalog = spark.createDataFrame([("a", True, "pair"), ("b", True, "pair"), ("c", True, "solo")], "guid string, paid boolean, package_key string")
    prices = F.array_join(F.transform(gifts.displayed_prices(F.col("price_text")), lambda p: F.concat_ws(":", p["currency"], p["amount"].cast("long").cast("string"))), ",")
    told = gifts.package_status(rows, known, catalog).select(F.col("page").cast("long").alias("page"), "place", "status", "package_key", "name_item", prices.alias("prices"), F.lit(None).cast("string").alias("reason"))
    return told.unionByName(rows.filter("reason IS NOT NULL").select(F.col("page").cast("long").alias("page"), "reason"), allowMissingColumns=True)


@query("SELECT p_partkey, 'r' || p_partkey AS record, p_name || ' {' || p_size || '}' AS name, CASE WHEN p_partkey % 3 = 0 THEN 'x}\"y' ELSE p_brand END AS inner_name FROM part WHERE p_partkey % 7 <> 0")
def nested_records(spark, sf):
    """Records with braces in strings, inner tables, and some that never end."""
    k = F.col("p_partkey")
    inner = F.when(k % 3 == 0, 'x}\\"y').otherwise(F.col("p_brand"))
    text = F.concat(F.lit("-- parts\nr"), k.cast("string"), F.lit(' = { n = 3, name = "'), "p_name", F.lit(" {"), F.col("p_size").cast("string"), F.lit("}\", in_ = { inner = \""), inner, F.lit('", deep = {} } '), F.when(k % 7 != 0, "}\n").otherwise("\n"))
    got = read_records(table(spark, sf, "part").select("p_partkey", text.alias("t")), "p_partkey", "t")
    return got.select("p_partkey", "record", F.col("fields")["name"].alias("name"), F.col("fields")["inner"].alias("inner_name"))
