"""Text queries: redaction, numbers, tokens, segments, records in lines and pages."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.functions import text as T
from marlstone.sources.tables import table

QUERIES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


@query(r"SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[email]', 'g'), '[0-9]{13,19}', '[number]', 'g'), '\(?\+?[0-9]{1,3}\)?[ -]?\(?[0-9]{3}\)?[ -][0-9]{3}[ -]?[0-9]{4}', '[phone]', 'g')) AS redacted_sha256 FROM documents")
def redact_pii(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(T.redact(F.col("text")), 256).alias("redacted_sha256"))


@query()
def normalize_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(T.normalize(F.col("text")), 256).alias("normalized_sha256"))


@query("WITH r AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) WHEN 1 THEN CAST(o_totalprice AS VARCHAR) WHEN 2 THEN replace(CAST(o_totalprice AS VARCHAR), '.', ',') ELSE '1.' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') END AS raw FROM orders), d AS (SELECT *, regexp_matches(raw, '[.,][0-9]{1,2}$') AS dec FROM r) SELECT o_orderkey, round(try_cast(regexp_replace(CASE WHEN dec THEN regexp_replace(raw, '[.,][0-9]{1,2}$', '') ELSE raw END, '[.,]', '', 'g') || '.' || CASE WHEN dec THEN regexp_extract(raw, '[.,]([0-9]{1,2})$', 1) ELSE '0' END AS DOUBLE), 6) AS price FROM d")
def localized_number(spark, sf):
    price = F.col("o_totalprice").cast("string")
    raw = F.when(F.col("o_orderkey") % 4 == 0, F.floor("o_totalprice").cast("string")).when(F.col("o_orderkey") % 4 == 1, price).when(F.col("o_orderkey") % 4 == 2, F.replace(price, F.lit("."), F.lit(","))).otherwise(F.concat(F.lit("1."), F.lpad((F.col("o_orderkey") % 1000).cast("string"), 3, "0")))
    return table(spark, sf, "orders").select("o_orderkey", raw.alias("raw")).select("o_orderkey", F.round(T.localized_number(F.col("raw")), 6).alias("price"))


@query("WITH r AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN CAST(p_size AS VARCHAR) || 'w' WHEN 1 THEN CAST(p_size AS VARCHAR) || '.5' ELSE CAST(p_size * 100 AS VARCHAR) END AS raw FROM part), n AS (SELECT *, try_cast(nullif(regexp_extract(raw, '^([0-9]+(\\.[0-9]+)?)', 1), '') AS DOUBLE) AS x FROM r) SELECT p_partkey, round(CASE WHEN ends_with(raw, 'w') OR (contains(raw, '.') AND x < 100) THEN x * 10000 ELSE x END) AS price FROM n")
def unit_scaled_number(spark, sf):
    size = F.col("p_size")
    raw = F.when(F.col("p_partkey") % 3 == 0, F.concat(size.cast("string"), F.lit("w"))).when(F.col("p_partkey") % 3 == 1, F.concat(size.cast("string"), F.lit(".5"))).otherwise((size * 100).cast("string"))
    return table(spark, sf, "part").select("p_partkey", raw.alias("raw")).select("p_partkey", T.unit_scaled(F.col("raw")).alias("price"))


@query(f"""SELECT s_suppkey, CASE WHEN n = '' THEN '{T.UNNAMED}' WHEN upper(split_part(n, '.', 1)) IN {T.RESERVED!r} THEN n || '{T.ACCOUNT}' ELSE n END AS file_name FROM (SELECT s_suppkey, regexp_replace(trim(regexp_replace(CASE s_suppkey % 5 WHEN 0 THEN 'con' WHEN 1 THEN '...' WHEN 2 THEN ' ' || s_name || '/a:b?. ' WHEN 3 THEN 'Lpt' || (s_suppkey % 10) || '.txt' ELSE s_name || chr(9) END, '[\\x00-\\x1F\\x7F\\\\/:*?"<>|]', '-', 'g')), '[. ]+$', '') AS n FROM supplier)""")
def safe_name(spark, sf):
    k = F.col("s_suppkey")
    raw = F.when(k % 5 == 0, "con").when(k % 5 == 1, "...").when(k % 5 == 2, F.concat(F.lit(" "), "s_name", F.lit("/a:b?. "))).when(k % 5 == 3, F.concat(F.lit("Lpt"), (k % 10).cast("string"), F.lit(".txt"))).otherwise(F.concat("s_name", F.lit("\t")))
    return table(spark, sf, "supplier").select("s_suppkey", T.safe_name(raw).alias("file_name"))


@query("SELECT s_suppkey, CAST(n AS VARCHAR) || CASE WHEN n % 100 BETWEEN 11 AND 13 THEN 'th' WHEN n % 10 = 1 THEN 'st' WHEN n % 10 = 2 THEN 'nd' WHEN n % 10 = 3 THEN 'rd' ELSE 'th' END AS label FROM (SELECT s_suppkey, s_suppkey * 5 + 1 AS n FROM supplier)")
def ordinal_label(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", T.ordinal(F.col("s_suppkey") * 5 + 1).alias("label"))


@query("SELECT event_id, coalesce(CASE WHEN event_id % 5 = 0 THEN 'forum' END, CASE event_type WHEN 'purchase' THEN 'shop' WHEN 'signup' THEN 'shop' WHEN 'view' THEN 'web' WHEN 'click' THEN 'web' END, 'unknown') AS channel FROM events")
def alias_map(spark, sf):
    names = F.create_map(*(F.lit(x) for pair in (("purchase", "shop"), ("signup", "shop"), ("view", "web"), ("click", "web")) for x in pair))
    return table(spark, sf, "events").select("event_id", F.coalesce(F.when(F.col("event_id") % 5 == 0, "forum"), F.try_element_at(names, F.col("event_type")), F.lit("unknown")).alias("channel"))


@query("SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: CASE w WHEN 'red' THEN 'rot' WHEN 'blue' THEN 'blau' WHEN 'small' THEN 'klein' WHEN 'ring' THEN 'Ring' ELSE w END), ' ') AS translated FROM part")
def token_map(spark, sf):
    words = F.create_map(*(F.lit(x) for pair in (("red", "rot"), ("blue", "blau"), ("small", "klein"), ("ring", "Ring")) for x in pair))
    return table(spark, sf, "part").select("p_partkey", F.array_join(F.transform(F.split("p_name", " "), lambda w: F.coalesce(F.try_element_at(words, w), w)), " ").alias("translated"))


@query("SELECT conv_id, turn, len(l) AS tokens, l[1] AS first_token FROM (SELECT conv_id, turn, list_filter(list_transform(string_split_regex(text, '[.,;!?]'), lambda x: trim(x)), lambda x: x <> '') AS l FROM conversations)")
def token_split(spark, sf):
    parts = F.filter(F.transform(F.split("text", "[.,;!?]"), lambda x: F.trim(x)), lambda x: x != "")
    return table(spark, sf, "conversations").select("conv_id", "turn", F.size(parts).cast("long").alias("tokens"), F.try_element_at(parts, F.lit(1)).alias("first_token"))


@query("WITH p AS (SELECT p_partkey, lower(p_name) AS a, lower(p_type) AS b FROM part), g AS (SELECT *, list_distinct(list_transform(range(1, greatest(len(a) - 1, 1) + 1), lambda i: substr(a, i, 2))) AS ga, list_distinct(list_transform(range(1, greatest(len(b) - 1, 1) + 1), lambda i: substr(b, i, 2))) AS gb FROM p), d AS (SELECT *, 2.0 * len(list_intersect(ga, gb)) / (len(ga) + len(gb)) AS dice FROM g) SELECT p_partkey, round(CASE WHEN contains(a, b) OR contains(b, a) THEN greatest(dice, CASE WHEN least(len(a), len(b)) >= 4 THEN 0.82 ELSE 0.78 END) ELSE dice END, 6) AS score FROM d")
def bigram_dice(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.lower("p_name").alias("a"), F.lower("p_type").alias("b"))
    return p.select("p_partkey", F.round(T.bigram_dice(F.col("a"), F.col("b")), 6).alias("score"))


@query("SELECT o_orderkey, CASE WHEN p > 0 THEN greatest(1.0, floor(p / u + 0.5) * u) END AS rounded FROM (SELECT o_orderkey, o_totalprice / 37 AS p, CASE WHEN o_totalprice / 37 >= 10000 THEN 100.0 WHEN o_totalprice / 37 >= 1000 THEN 10.0 ELSE 1.0 END::DOUBLE AS u FROM orders)")
def round_price(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", T.round_price(F.col("o_totalprice") / 37).alias("rounded"))


@query("SELECT o_orderkey, round(exp(0.7 * ln(o_totalprice) + 0.3 * ln(o_totalprice * (1 + (o_orderkey % 10) / 10.0))), 4) AS blended FROM orders")
def geo_blend(spark, sf):
    a = F.col("o_totalprice")
    return table(spark, sf, "orders").select("o_orderkey", F.round(F.exp(0.7 * F.ln(a) + 0.3 * F.ln(a * (1 + (F.col("o_orderkey") % 10) / F.lit(10.0)))), 4).alias("blended"))


@query("WITH r AS (SELECT p_partkey, CAST(1 + p_size % 5 AS VARCHAR) || ' to ' || CAST(6 + p_size % 7 AS VARCHAR) || ', ' || CAST(p_size AS VARCHAR) AS raw, 1 + p_size % 5 AS a, 6 + p_size % 7 AS b, p_size AS c FROM part) SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(range(a, b + 1), [c]))), ',') AS ordinals FROM r")
def range_expand(spark, sf):
    size = F.col("p_size")
    raw = F.concat((1 + size % 5).cast("string"), F.lit(" to "), (6 + size % 7).cast("string"), F.lit(", "), size.cast("string"))
    pairs = F.regexp_extract_all("raw", F.lit("([0-9]+)( to ([0-9]+))?"), 0)
    def ends(x):
        return F.sequence(F.regexp_extract(x, "^([0-9]+)", 1).cast("int"), F.coalesce(F.nullif(F.regexp_extract(x, "to ([0-9]+)", 1), F.lit("")), F.regexp_extract(x, "^([0-9]+)", 1)).cast("int"))
    p = table(spark, sf, "part").select("p_partkey", raw.alias("raw"))
    return p.select("p_partkey", F.array_join(F.array_sort(F.array_distinct(F.flatten(F.transform(pairs, ends)))), ",").alias("ordinals"))


_WORDS = ("license", "worthless", "http", "the", "und", "pour", "para", "mail")


@query("SELECT doc_id, array_to_string(list_filter(['license', 'worthless', 'http', 'the', 'und', 'pour', 'para', 'mail'], lambda w: contains(lower(text), w)), ',') AS mentions FROM documents")
def dictionary_mentions(spark, sf):
    low = F.lower("text")
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.filter(F.array(*(F.lit(w) for w in _WORDS)), lambda w: F.contains(low, w)), ",").alias("mentions"))


@query("WITH t AS (SELECT conv_id, turn, role, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS seg FROM conversations) SELECT conv_id, CAST(seg AS BIGINT) AS segment, count(*) AS turns, string_agg(role, '>' ORDER BY turn) AS roles FROM t GROUP BY ALL")
def segment_split(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, sf, "conversations").withColumn("segment", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(w))
    a = t.groupBy("conv_id", "segment").agg(F.count("*").alias("turns"), F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("r"))
    return a.select("conv_id", "segment", "turns", F.array_join(F.transform("r", lambda x: x["role"]), ">").alias("roles"))


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents), s AS (SELECT *, sum(CASE WHEN length(line) < 12 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS section FROM l) SELECT doc_id, CAST(section AS BIGINT) AS section, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars FROM s GROUP BY ALL")
def section_split(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("k", "line"))
    w = Window.partitionBy("doc_id").orderBy("k")
    s = lines.withColumn("section", F.sum(F.when(F.length("line") < 12, 1).otherwise(0)).over(w))
    return s.groupBy("doc_id", "section").agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"))


@query("WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents), f AS (SELECT * FROM l WHERE line <> ''), n AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY k) AS value FROM f) SELECT doc_id, CAST(k AS BIGINT) AS place, line AS label, CAST(length(value) AS BIGINT) AS value_length FROM n WHERE length(line) <= 20 AND value IS NOT NULL")
def label_value_lines(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("k", "line")).withColumn("line", F.trim("line")).filter("line <> ''")
    n = lines.withColumn("value", F.lead("line").over(Window.partitionBy("doc_id").orderBy("k")))
    return n.filter((F.length("line") <= 20) & F.col("value").isNotNull()).select("doc_id", (F.col("k") + 1).cast("long").alias("place"), F.col("line").alias("label"), F.length("value").cast("long").alias("value_length"))


@query('''WITH m AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS h, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS t FROM pages) SELECT page_id, unnest(h) AS href, unnest(t) AS label FROM m''')
def html_link_extract(spark, sf):
    tag = F.lit('<a href="([^"]*)">([^<]*)</a>')
    m = table(spark, sf, "pages").select("page_id", F.regexp_extract_all("html", tag, 1).alias("href"), F.regexp_extract_all("html", tag, 2).alias("label"))
    return m.select("page_id", F.inline(F.arrays_zip("href", "label")))


@query("SELECT page_id, CAST(len(regexp_extract_all(html, '<p>')) AS BIGINT) AS paragraphs, CAST(len(regexp_extract_all(html, '</p>')) AS BIGINT) AS closed, len(regexp_extract_all(html, '<p>')) = len(regexp_extract_all(html, '</p>')) AS consistent FROM pages")
def declared_count_check(spark, sf):
    n, c = F.regexp_count("html", F.lit("<p>")).cast("long"), F.regexp_count("html", F.lit("</p>")).cast("long")
    return table(spark, sf, "pages").select("page_id", n.alias("paragraphs"), c.alias("closed"), (n == c).alias("consistent"))


@query("WITH m AS (SELECT doc_id, regexp_extract_all(text, '([A-Z][a-z]{2,})[.] ([A-Z][a-z]{2,}) ([a-z]{3,})', 1) AS a, regexp_extract_all(text, '([A-Z][a-z]{2,})[.] ([A-Z][a-z]{2,}) ([a-z]{3,})', 2) AS b, regexp_extract_all(text, '([A-Z][a-z]{2,})[.] ([A-Z][a-z]{2,}) ([a-z]{3,})', 3) AS c FROM documents) SELECT doc_id, unnest(a) AS name, unnest(b) AS place, unnest(c) AS word FROM m")
def text_record_extract(spark, sf):
    p = F.lit("([A-Z][a-z]{2,})[.] ([A-Z][a-z]{2,}) ([a-z]{3,})")
    m = table(spark, sf, "documents").select("doc_id", *(F.regexp_extract_all("text", p, k).alias(c) for k, c in ((1, "name"), (2, "place"), (3, "word"))))
    return m.select("doc_id", F.inline(F.arrays_zip("name", "place", "word")))


_PRICE = "SELECT doc_id, list_distinct(list_filter(list_transform(regexp_extract_all(text, '(^|[^0-9])([0-9]{3,6})([^0-9]|$)', 2), lambda x: CAST(x AS BIGINT)), lambda x: x BETWEEN 100 AND 500000)) AS ps FROM documents"


@query(f"SELECT doc_id, CASE WHEN len(ps) = 1 THEN ps[1] END AS price, CASE WHEN len(ps) = 0 THEN 'missing' WHEN len(ps) > 1 THEN 'ambiguous' END AS reason FROM ({_PRICE})")
def price_extract(spark, sf):
    found = F.array_distinct(F.filter(F.transform(F.regexp_extract_all("text", F.lit("(^|[^0-9])([0-9]{3,6})([^0-9]|$)"), 2), lambda x: x.cast("long")), lambda x: x.between(100, 500000)))
    d = table(spark, sf, "documents").select("doc_id", found.alias("ps"))
    return d.select("doc_id", F.when(F.size("ps") == 1, F.col("ps")[0]).alias("price"), F.when(F.size("ps") == 0, "missing").when(F.size("ps") > 1, "ambiguous").alias("reason"))


@query("SELECT conv_id, turn, CASE WHEN regexp_matches(t, '(not|kein|pas de|sin) [a-z]+') THEN NULL WHEN regexp_matches(t, '^(the|der|le|el) ') THEN 'definite' WHEN regexp_matches(t, '^[a-z]+[.]') THEN 'short' END AS claim, CAST(len(regexp_extract_all(t, '[0-9]+')) AS BIGINT) AS numbers FROM (SELECT conv_id, turn, lower(text) AS t FROM conversations)")
def title_evidence(spark, sf):
    t = F.col("t")
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.lower("text").alias("t"))
    return c.select("conv_id", "turn", F.when(t.rlike("(not|kein|pas de|sin) [a-z]+"), None).when(t.rlike("^(the|der|le|el) "), "definite").when(t.rlike("^[a-z]+[.]"), "short").alias("claim"), F.regexp_count(t, F.lit("[0-9]+")).cast("long").alias("numbers"))


@query("SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS exact, CASE WHEN value >= 100 THEN 'over' WHEN value >= 50 THEN 'about' ELSE 'exact' END AS kind, round(CASE WHEN value >= 100 THEN floor(value / 100) * 100 ELSE value END, 4) AS quantity FROM events")
def quantity_extract(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").select("event_id", F.regexp_extract("props", "([0-9]+)", 1).cast("long").alias("exact"), F.when(v >= 100, "over").when(v >= 50, "about").otherwise("exact").alias("kind"), F.round(F.when(v >= 100, F.floor(v / 100) * 100.0).otherwise(v), 4).alias("quantity"))


@query("SELECT doc_id, l[1] AS headline FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) >= 25 AND NOT regexp_matches(x, '^[^a-z]*$')) AS l FROM documents)")
def first_usable(spark, sf):
    lines = F.filter(F.transform(F.split("text", "\n", -1), lambda x: F.trim(x)), lambda x: (F.length(x) >= 25) & ~x.rlike("^[^a-z]*$"))
    return table(spark, sf, "documents").select("doc_id", F.try_element_at(lines, F.lit(1)).alias("headline"))


@query("WITH l AS (SELECT doc_id, unnest(list_slice(string_split(text, chr(10)), 1, 12)) AS line FROM documents), c AS (SELECT doc_id, regexp_extract(line, '(MIT|Apache|GNU|CC BY)', 1) AS claim FROM l) SELECT doc_id, CASE WHEN count(DISTINCT claim) = 1 THEN min(claim) END AS claim, count(DISTINCT claim) AS claims FROM c WHERE claim <> '' GROUP BY 1")
def unique_claim(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.explode(F.slice(F.split("text", "\n", -1), 1, 12)).alias("line"))
    c = lines.select("doc_id", F.regexp_extract("line", "(MIT|Apache|GNU|CC BY)", 1).alias("claim")).filter("claim <> ''")
    return c.groupBy("doc_id").agg(F.when(F.count_distinct("claim") == 1, F.min("claim")).alias("claim"), F.count_distinct("claim").alias("claims"))


#: Dictionary spans, longest first, which is the order in which they are tried at each place.
_SPANS = "not the|the end|and the|the|end"


@query(rf"SELECT doc_id, span, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), '\b({_SPANS})\b', 1)) AS span FROM documents) GROUP BY ALL")
def span_scan(spark, sf):
    """All occurrences of a small dictionary, longest first at each place, greedily without overlap."""
    words = F.regexp_replace(F.lower("text"), "[^a-z]+", " ")
    found = F.regexp_extract_all(words, F.lit(rf"\b({_SPANS})\b"), F.lit(1))
    return table(spark, sf, "documents").select("doc_id", F.explode(found).alias("span")).groupBy("doc_id", "span").agg(F.count("*").alias("n"))
