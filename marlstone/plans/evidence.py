"""Evidence queries: why segments, accounts, sales and asks are refused, the health of a collection, translated names."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions.marks import normalised
from marlstone.operators import rejections as R
from marlstone.sources.tables import table

QUERIES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def _but(k, n, good, changes):
    """`good`, a row's fields, with the one of `changes` that k modulo n names: (place, field, value)."""
    out = {}
    for c, value in good.items():
        for at, field, other in changes:
            if field == c:
                value = F.when(k % n == at, other).otherwise(value)
        out[c] = value
    return out


_SEGMENT = ["#收 魔法號", "魔法號 8000", "#售\n#收 號", "#換 魔法號", "#售 代儲", "#售 國服號", "#售 無翼號", "#售 iPhone", "#售 競標", "估價 #售", "#售 魔法號", "預算 5000"]


@query("SELECT o_orderkey, ['buy_not_sell', 'missing_sell_intent', NULL, 'missing_sell_intent', 'service_or_topup', 'foreign_or_china_market', 'modified_or_special_account', 'mixed_goods', 'auction', NULL, NULL, 'buy_not_sell'][o_orderkey % 12 + 1] AS alone, ['buy_not_sell', NULL, NULL, 'swap_not_sell', 'service_or_topup', 'foreign_or_china_market', 'modified_or_special_account', 'mixed_goods', 'auction', NULL, NULL, 'buy_not_sell'][o_orderkey % 12 + 1] AS in_post FROM orders")
def segment_reasons(spark, sf):
    """An offer's reason by itself, and as part of a post that sells."""
    text = F.get(F.array(*(F.lit(t) for t in _SEGMENT)), (F.col("o_orderkey") % 12).cast("int"))
    t = table(spark, sf, "orders").select("o_orderkey", normalised(text).alias("t"))
    return t.select("o_orderkey", R.segment_reason(F.col("t"), F.col("t")).alias("alone"), R.segment_reason(F.col("t"), F.lit("#代出 號")).alias("in_post"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 14 = 12 THEN 'reviewed_out' WHEN o_orderkey % 14 = 13 THEN 'reviewed_out' ELSE [NULL, 'data_without_account', 'not_account_ask', 'not_account_ask', 'foreign_or_converted', 'foreign_or_converted', 'special_or_modified_account', 'not_single_account_point_ask', NULL, 'currency_unconfirmed', 'invalid_price', 'missing_provenance'][o_orderkey % 14 + 1] END AS reason FROM orders")
def account_reasons(spark, sf):
    """Whole-account evidence; a review confirms some mixed goods, excludes some rows, and their duplicates with them."""
    k, n = F.col("o_orderkey"), 14
    good = {"summary": F.lit("音韻多禮 3.8萬"), "price_raw": F.lit("38000 台幣"), "price": F.lit(38000.0), "price_kind": F.lit("ask"), "intent": F.lit("sell"), "source_url": F.lit("https://www.facebook.com/x"), "market": F.lit(None).cast("string"), "converted": F.lit(False)}
    changes = [(1, "summary", "只有數據，無本體"), (2, "intent", "buy"), (3, "price_kind", "sold"), (4, "market", "china"), (5, "converted", True), (6, "summary", "刷號"), (7, "summary", "起標"), (8, "summary", "附實體徽章"), (9, "price_raw", "38000"), (10, "price", 0.0), (11, "source_url", "http://x")]
    rows = table(spark, sf, "orders").select("o_orderkey", k.cast("string").alias("post_key"), *(v.alias(c) for c, v in _but(k, n, good, changes).items()))
    mine = rows.filter((k % n).isin(8, 12, 13))
    decisions = mine.select("post_key", F.when(k % n == 12, "reviewed_out").alias("exclude"), F.when(k % n == 13, (k - 1).cast("string")).alias("duplicate_of"), (k % n == 8).alias("account_only_confirmed"))
    # Keys are sparse: a duplicate whose root has no row is told so by the row itself.
    has = rows.filter(k % n == 12).select((k + 1).cast("string").alias("post_key"), F.lit(True).alias("_has"))
    decisions = decisions.join(has, "post_key", "left").withColumn("exclude", F.when(F.col("duplicate_of").isNotNull() & F.col("_has").isNull(), "reviewed_out").otherwise(F.col("exclude"))).drop("_has")
    return R.whole_account_reasons(rows, decisions).select("o_orderkey", "reason")


_SOLD = ["NULL", "'quarantined_identity'", "'legacy_requires_evidence_review'", "'not_transaction_price'", "'missing_provenance'", "'identity_or_quarantine_unreviewed'", "'transaction_evidence_unconfirmed'", "'invalid_transaction_date'", "'stale_transaction'", "'foreign_or_unknown_market'", "'not_comparable_account_price'", "'invalid_price'", "'invalid_season'", "'invalid_categories'", "'quarantined_identity'"]


@query(f"SELECT c_custkey, [{', '.join(_SOLD)}][c_custkey % 15 + 1] AS reason FROM customer")
def transaction_reasons(spark, sf):
    """Confirmed sales, each with one thing wrong; a quarantined row takes the one that shares its account with it."""
    k, n, flag = F.col("c_custkey"), 15, F.lit(True)
    good = {
        "id": k.cast("string"), "account_key": F.concat(F.lit("a"), F.when(k % n == 14, F.floor(k / n) * n + 1).otherwise(k).cast("string")), "post_key": F.concat(F.lit("p"), k.cast("string")), "receipt": F.sha2(k.cast("string"), 256), "source_group": F.lit("g"), "source_url": F.lit("https://x"),
        "schema_version": F.lit(1), "price_kind": F.lit("sold"), "account_identity_verified": flag, "known_answer": F.lit(False), "reviewed": flag, "reviewed_at": F.lit("2024-03-01"), "transaction_confirmed": flag, "price_quote": F.lit("q"), "date_quote": F.lit("d"), "sold_at": F.lit("2024-01-01"),
        "market": F.lit("taiwan"), "server": F.lit("international"), "currency": F.lit("TWD"), "converted": F.lit(False), "intent": F.lit("sell"), "account_only": flag, "account_style": F.lit("normal"), "price_basis": F.lit("account_excluding_fees"), "price": F.lit(5.0), "season": F.lit("rhythm"), "package_tier": F.lit(None).cast("string"), "break_class": F.lit("none"), "exclude_from_model": F.lit(False),
    }
    changes = [(1, "exclude_from_model", True), (2, "schema_version", 2), (3, "price_kind", "ask"), (4, "source_url", "x"), (5, "account_identity_verified", False), (6, "date_quote", " "), (7, "sold_at", "2024-02-30"), (8, "sold_at", "2022-01-01"), (9, "currency", "USD"), (10, "account_style", "odd"), (11, "price", F.lit(float("nan"))), (12, "season", "winter"), (13, "break_class", "huge")]
    # 14 shares its account with the 1 of its own fifteen; where the table ends before, it is excluded itself.
    rows = table(spark, sf, "customer").select("c_custkey", *(v.alias(c) for c, v in _but(k, n, good, changes).items()))
    return R.transaction_reasons(rows, "2024-06-01", ("rhythm",)).select("c_custkey", "reason")


_FRESH = ["NULL", "'missing_provenance'", "'not_freshly_reviewed'", "'not_account_only_sale'", "'unknown_start_season'", "'publication_date_unknown'", "'stale'", "'foreign_or_unknown_market'", "'invalid_price'", "'unconfirmed_transaction_price'", "NULL"]


@query(f"SELECT c_custkey, [{', '.join(_FRESH)}][c_custkey % 11 + 1] AS reason, CASE c_custkey % 11 WHEN 0 THEN 'recent180' WHEN 10 THEN 'extended365' END AS window FROM customer")
def fresh_reasons(spark, sf):
    k, n, flag = F.col("c_custkey"), 11, F.lit(True)
    good = {"id": k.cast("string"), "account_key": F.lit("a"), "post_key": F.lit("p"), "source_group": F.lit("g"), "source_url": F.lit("https://x"), "reviewed": flag, "reviewed_at": F.lit("2024-05-01"), "account_only": flag, "intent": F.lit("sell"), "season": F.lit("rhythm"), "published_at": F.lit("2024-04-01"), "market": F.lit("taiwan"), "server": F.lit("international"), "currency": F.lit("TWD"), "price_kind": F.lit("ask"), "price": F.lit(5.0)}
    changes = [(1, "source_group", ""), (2, "reviewed_at", "2023-01-01"), (3, "intent", "buy"), (4, "season", None), (5, "published_at", "soon"), (6, "published_at", "2023-01-01"), (7, "server", "china"), (8, "price", -1.0), (9, "price_kind", "sold"), (10, "published_at", "2023-09-01")]
    rows = table(spark, sf, "customer").select("c_custkey", *(v.alias(c) for c, v in _but(k, n, good, changes).items()))
    return R.fresh_reasons(rows, "2024-06-01", "2024-01-01", ("rhythm",)).select("c_custkey", "reason", "window")


@query("""
WITH p AS (SELECT user_id, CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY ALL), g AS (SELECT user_id, CAST(date_diff('day', DATE '2024-01-01', d) + 1 AS INTEGER) AS page, n FROM p),
s AS (SELECT user_id, max(page) AS seen FROM g GROUP BY 1), a AS (SELECT user_id, page FROM s, range(1, seen + 3) t(page)),
j AS (SELECT a.user_id, CAST(a.page AS INTEGER) AS page, CASE WHEN user_id % 9 = 0 AND a.page = 3 THEN 'request_failed' WHEN g.n IS NULL THEN 'empty' ELSE 'ok' END AS status, CASE WHEN user_id % 9 = 0 AND a.page = 3 THEN 0 ELSE coalesce(n, 0) END AS rows FROM a LEFT JOIN g USING (user_id, page)),
l AS (SELECT *, coalesce(max(page) FILTER (rows > 0) OVER (PARTITION BY user_id), 0) AS last FROM j)
SELECT user_id, CAST(sum(rows) AS BIGINT) AS rows, any_value(last) AS last_nonempty_page, count(*) FILTER (status = 'request_failed') AS failed, count(*) FILTER (status = 'empty' AND page <= last) AS internal_empty, count(*) FILTER (status = 'empty' AND page > last) AS trailing_empty,
       any_value(last) > 0 AND coalesce(max(rows) FILTER (page = last), 0) BETWEEN 1 AND 19 AND count(*) FILTER (page > last) > 0 AND count(*) FILTER (page > last AND status <> 'empty') = 0 AS end_confirmed,
       count(*) FILTER (page = 1 AND status = 'ok') > 0 AND count(*) FILTER (status = 'request_failed') = 0 AND count(*) FILTER (status = 'empty' AND page <= last) = 0 AS healthy FROM l GROUP BY 1
""")
def collection_health(spark, sf):
    """A user's days as pages, two empty ones behind the last, and a failed third page of some."""
    g = table(spark, sf, "events").groupBy("user_id", (F.date_diff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) + 1).alias("page")).agg(F.count("*").alias("n"))
    every = g.groupBy("user_id").agg(F.max("page").alias("m")).select("user_id", F.explode(F.sequence(F.lit(1), F.col("m") + 2)).alias("page"))
    failed = (F.col("user_id") % 9 == 0) & (F.col("page") == 3)
    pages = every.join(g, ["user_id", "page"], "left").select("user_id", "page", F.when(failed, "request_failed").when(F.col("n").isNull(), "empty").otherwise("ok").alias("status"), F.when(failed, 0).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("rows"))
    h = R.collection_health(pages, "user_id")
    return h.select("user_id", "rows", "last_nonempty_page", *(F.size(c).cast("long").alias(n) for c, n in (("failed_pages", "failed"), ("internal_empty_pages", "internal_empty"), ("trailing_empty_pages", "trailing_empty"))), "end_confirmed", "healthy")


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'ganz' ELSE array_to_string(list_transform(string_split(replace(replace(p_name, ' ', '-') || CASE WHEN p_partkey % 2 = 0 THEN ' of Anna' ELSE '' END, '-', ' '), ' '), lambda w: CASE w WHEN 'red' THEN 'rot' WHEN 'small' THEN 'klein' WHEN 'ring' THEN 'Ring' WHEN 'gear' THEN 'Rad' WHEN 'of' THEN 'von' ELSE w END), '') END AS translated FROM part")
def translated_names(spark, sf):
    """Names by whole-name tables first, then word by word through five levels, an earlier level before a later one."""
    k = F.col("p_partkey")
    hyphened = F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.when(k % 2 == 0, " of Anna's").otherwise(""))
    names = table(spark, sf, "part").select("p_partkey", F.when(k % 5 == 0, "all of it").otherwise(hyphened).alias("name"))
    one = lambda *pairs: spark.createDataFrame(list(pairs), "a string, b string")
    words = [one(("red", "rot")), one(("red", "no"), ("small", "klein")), one(("ring", "Ring")), one(("gear", "Rad"), ("ring", "no")), one(("of", "von"), ("gear", "no"))]
    return R.translated(names, "p_partkey", "name", [one(("none", "x")), one(("all of it", "ganz"))], words)
