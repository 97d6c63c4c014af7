"""Why evidence is refused: ordered reasons for listings' segments, whole accounts, confirmed sales and fresh asks.

Each function adds `reason`, the first that holds, null for what is accepted.  A null field never accepts by accident: a
condition that can't be told counts as not met.  Fields that a table lacks are null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.listings import data_only
from marlstone.operators.filters import reason_cascade
from marlstone.operators.identity import components, quarantine, root_chain
from marlstone.operators.models import BREAKS, TIERS

# Words of a segment that buy, sell, swap, serve, price abroad, were modified, mix goods, auction, or ask for a price.
BUY = r"(?:^|[\s#＃])(?:收|求購|求购|徵|征|尋|寻|想收|預算|预算|蹲)(?=$|[\s:：#＃])"
SELL = r"(?:^|[\s#＃])(?:售|出售|賣|卖|代出|代售|代掛|代挂|緩出|缓出|緩售|缓售|急售|秒出|已售|已出)(?=$|[\s:：#＃])"
SWAP = r"(?:^|[\s#＃])(?:換|换|交換|交换|主換|主换)(?=$|[\s:：#＃])"
SERVICE = "代儲|代充|陪玩|跑圖|跑图|互心|季卡|代跑|工作室|租號|租号"
ABROAD = r"(?i)國服|国服|渠道服|安卓服|華為服|华为服|人民幣|人民币|\bRMB\b|\bCNY\b|港幣|港币|\bHKD\b|馬幣|马币|\bRM\b|美元|\bUSD\b"
MODIFIED = r"刷號|刷号|刷篝火|猛\s*0|科技號|科技号|修改號|修改号|無翼|无翼"
GOODS = "(?i)iphone|安卓手機|安卓手机|禮物卡|礼物卡|實體徽章|实体徽章|周邊|周边|合售"
AUCTION, ESTIMATE = "競標|竞标|起標|起标|喊價|喊价|價高者得|价高者得", "估價|估价|問價|问价|值多少|多少錢|多少钱"
# Words of whole-account evidence that is foreign, modified, no single price, mixed; and of its currency and source.
FOREIGN_TEXT = r"國服|中國服|陆服|陸服|网易|網易|約\s*[\d.,]+台|人民幣直出|RM約"
SPECIAL_TEXT = "刷號|刷禮|刷鳥|刷火|刷紅|刷畢|非正規|髒號|无翼|無翼|墜機"
NOT_ONE_TEXT, MIXED_TEXT = r"競標|起標|拍賣|底價|兩萬內|\d+k以下|合售|每隻", r"徽章|勳章|實體|周邊|\d+徽"
CURRENCY_TEXT, SOURCE = r"(?i)台幣|臺幣|台|NTD|TWD|NT\$", r"^https://www\.facebook\.com/"
#: How long a sale or an ask counts, and up to when an ask is recent, in days. Fixed values.
DAYS, RECENT = 365, 180


def _with(rows: DataFrame, **kinds: str) -> DataFrame:
    """`rows` with the fields that they lack, null."""
    return rows.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items() if c not in rows.columns})


def _yes(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(False))


def _is(c: str, *values) -> Column:
    return F.coalesce(F.col(c).isin(*values), F.lit(False))


def _filled(*names: str) -> Column:
    out = F.lit(True)
    for c in names:
        out = out & F.coalesce(F.trim(c) != "", F.lit(False))
    return out


def _day(c: str) -> Column:
    """A real calendar day, or null."""
    return F.when(F.col(c).rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.col(c).try_cast("date"))


def _so(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def segment_reason(segment: Column, parent: Column) -> Column:
    """Of one offer of a post, whose beginning (`parent`) may say for all what is done with them."""
    sells, buys, all_sell = segment.rlike(SELL), segment.rlike(BUY), parent.rlike(SELL)
    neither = ~sells & ~all_sell
    return reason_cascade([
        ("buy_not_sell", neither & (buys | parent.rlike(BUY))), ("missing_sell_intent", neither), ("buy_not_sell", buys & ~sells), ("swap_not_sell", segment.rlike(SWAP) & ~sells),
        ("service_or_topup", segment.rlike(SERVICE)), ("foreign_or_china_market", segment.rlike(ABROAD)), ("modified_or_special_account", segment.rlike(MODIFIED)),
        ("mixed_goods", segment.rlike(GOODS)), ("auction", segment.rlike(AUCTION)), ("estimate_only", segment.rlike(ESTIMATE) & ~sells),
    ])


def whole_account_reasons(rows: DataFrame, decisions: DataFrame | None = None, kinds: tuple[str, ...] = ("ask",)) -> DataFrame:
    """rows: post_key, summary, price_raw, price, price_kind, intent, source_url, and what else the reasons name.

    decisions: post_key, exclude (a reason), duplicate_of, account_only_confirmed, currency_confirmed: a review's own
    exclusion comes first, and what excludes the root of a chain of duplicates excludes all that hang on it."""
    rows = _with(rows, summary="string", price_raw="string", currency="string", server="string", market="string", converted="boolean", exclude_from_model="boolean", price="double", source_url="string", intent="string", price_kind="string")
    if decisions is None:
        told = rows.withColumns({"_exclude": F.lit(None).cast("string"), "_only": F.lit(False), "_paid": F.lit(False)})
    else:
        d = _with(decisions, exclude="string", duplicate_of="string", account_only_confirmed="boolean", currency_confirmed="boolean")
        chain = root_chain(d.select("post_key", "duplicate_of"), "post_key", "duplicate_of").select("post_key", "root", F.col("duplicate_of").alias("_to"))
        roots = d.select(F.col("post_key").alias("root"), F.col("exclude").alias("_above"))
        each = d.join(chain, "post_key").join(roots, "root", "left").select("post_key", F.coalesce("exclude", "_above").alias("_exclude"), _yes("account_only_confirmed").alias("_only"), _yes("currency_confirmed").alias("_paid"))
        told = rows.join(each, "post_key", "left")
    text = F.concat_ws(" ", "summary", "price_raw")
    other = lambda c, value: F.col(c).isNotNull() & (F.col(c) != value)
    reason = reason_cascade([
        ("data_without_account", _so(data_only(text))),
        ("not_account_ask", _yes("exclude_from_model") | ~_is("intent", "sell") | ~_is("price_kind", *kinds)),
        ("foreign_or_converted", other("currency", "TWD") | other("server", "international") | other("market", "taiwan") | text.rlike(FOREIGN_TEXT) | _yes("converted")),
        ("special_or_modified_account", text.rlike(SPECIAL_TEXT)),
        ("not_single_account_point_ask", text.rlike(NOT_ONE_TEXT)),
        ("mixed_goods", text.rlike(MIXED_TEXT) & ~_yes("_only")),
        ("currency_unconfirmed", ~text.rlike(CURRENCY_TEXT) & ~_yes("_paid")),
        ("invalid_price", ~_so((F.col("price") > 0) & (F.col("price") < float("inf")))),
        ("missing_provenance", ~_filled("post_key") | ~_so(F.col("source_url").rlike(SOURCE))),
    ])
    return told.withColumn("reason", F.coalesce("_exclude", reason)).drop("_exclude", "_only", "_paid")


def transaction_reasons(rows: DataFrame, as_of: str, seasons: tuple[str, ...]) -> DataFrame:
    """Confirmed sales: with every proof, comparable, at most DAYS old on the day `as_of`.  Rows that share an account, a post
    or a receipt are one identity, and one quarantined row quarantines all of it, rejected ones too."""
    rows = _with(rows, known_answer="boolean", exclude_from_model="boolean").withColumn("_row", F.xxhash64(F.struct(*rows.columns)))
    linked = components(rows, "_row", ["account_key", "post_key", "receipt"])
    linked = quarantine(linked, _yes("known_answer") | _yes("exclude_from_model"))
    now, reviewed, sold = F.lit(as_of).cast("date"), _day("reviewed_at"), _day("sold_at")
    known = lambda c, names: F.col(c).isNull() | F.col(c).isin(*names)
    reason = reason_cascade([
        ("quarantined_identity", F.col("quarantined")),
        ("legacy_requires_evidence_review", ~_is("schema_version", 1)),
        ("not_transaction_price", ~_is("price_kind", "sold")),
        ("missing_provenance", ~_filled("id", "account_key", "post_key", "source_group") | ~_so(F.col("source_url").startswith("https://"))),
        ("identity_or_quarantine_unreviewed", ~_yes("account_identity_verified") | ~_so(~F.col("known_answer"))),
        ("transaction_evidence_unconfirmed", ~_yes("reviewed") | ~_so(reviewed <= now) | ~_yes("transaction_confirmed") | ~_so(F.col("receipt").rlike("^[a-f0-9]{64}$")) | ~_filled("price_quote", "date_quote")),
        ("invalid_transaction_date", ~_so((sold <= reviewed) & (sold <= now))),
        ("stale_transaction", F.date_diff(now, sold) > DAYS),
        ("foreign_or_unknown_market", ~_is("market", "taiwan") | ~_is("server", "international") | ~_is("currency", "TWD") | ~_so(~F.col("converted"))),
        ("not_comparable_account_price", ~_is("intent", "sell") | ~_yes("account_only") | ~_is("account_style", "normal") | ~_is("price_basis", "account_excluding_fees")),
        ("invalid_price", ~_so((F.col("price") > 0) & (F.col("price") < float("inf")))),
        ("invalid_season", ~known("season", seasons)),
        ("invalid_categories", ~known("package_tier", TIERS) | ~known("break_class", BREAKS)),
    ])
    return linked.withColumn("reason", reason).drop("_row", "quarantined")


def fresh_reasons(rows: DataFrame, as_of: str, since: str, seasons: tuple[str, ...]) -> DataFrame:
    """Reviewed asks and sales, published at most DAYS ago and reviewed from `since` on; adds `window` for what is accepted."""
    rows = _with(rows, exclude_from_model="boolean", converted="boolean", transaction_confirmed="boolean")
    now, first, reviewed, published = F.lit(as_of).cast("date"), F.lit(since).cast("date"), _day("reviewed_at"), _day("published_at")
    reason = reason_cascade([
        ("missing_provenance", ~_filled("id", "account_key", "post_key", "source_group") | ~_so(F.col("source_url").startswith("https://"))),
        ("not_freshly_reviewed", ~_yes("reviewed") | ~_so(reviewed.between(first, now))),
        ("not_account_only_sale", _yes("exclude_from_model") | ~_yes("account_only") | ~_is("intent", "sell")),
        ("unknown_start_season", ~_is("season", *seasons)),
        ("publication_date_unknown", ~_so(published <= now)),
        ("stale", F.date_diff(now, published) > DAYS),
        ("foreign_or_unknown_market", ~_is("market", "taiwan") | ~_is("server", "international") | ~_is("currency", "TWD") | _yes("converted")),
        ("invalid_price", ~_is("price_kind", "ask", "sold", "manual") | ~_so((F.col("price") > 0) & (F.col("price") < float("inf")))),
        ("unconfirmed_transaction_price", _is("price_kind", "sold") & ~_yes("transaction_confirmed")),
    ])
    window = F.when(F.date_diff(now, published) <= RECENT, "recent180").otherwise("extended365")
    return rows.withColumn("reason", reason).withColumn("window", F.when(F.col("reason").isNull(), window))


def collection_health(pages: DataFrame, source: str, full: int = 20, enough: int = 40) -> DataFrame:
    """From (source, page, status, rows) of a paged collection, one row for each source: rows, last_nonempty_page,
    failed_pages (arrays), internal_empty_pages, trailing_empty_pages, end_confirmed, healthy and eligible.

    status: ok, empty, unhealthy or request_failed.  The end is confirmed by a last page that isn't full and pages behind
    it that are all empty; a source is healthy with its first page and without failed, unhealthy or internal empty ones."""
    last = pages.groupBy(source).agg(F.coalesce(F.max(F.when(F.col("rows") > 0, F.col("page"))), F.lit(0)).alias("last"))
    p = pages.join(last, source)
    listed = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col("page"))))
    behind = F.col("page") > F.col("last")
    told = p.groupBy(source, "last").agg(
        F.sum("rows").alias("rows"), listed(F.col("status").isin("request_failed", "unhealthy")).alias("failed_pages"),
        listed((F.col("status") == "empty") & ~behind).alias("internal_empty_pages"), listed((F.col("status") == "empty") & behind).alias("trailing_empty_pages"),
        F.max(F.when(F.col("page") == F.col("last"), F.col("rows"))).alias("_size"), F.count_if(behind).alias("_behind"), F.count_if(behind & (F.col("status") != "empty")).alias("_not_empty"),
        F.coalesce(F.bool_or((F.col("page") == 1) & (F.col("status") == "ok")), F.lit(False)).alias("_first"), F.count("*").alias("_asked"),
    )
    end = (F.col("last") > 0) & (F.col("_size") > 0) & (F.col("_size") < full) & (F.col("_behind") > 0) & (F.col("_not_empty") == 0)
    healthy = F.col("_first") & (F.size("failed_pages") == 0) & (F.size("internal_empty_pages") == 0)
    sound = told.withColumns({"end_confirmed": F.coalesce(end, F.lit(False)), "healthy": healthy})
    return sound.select(source, "rows", F.col("last").alias("last_nonempty_page"), "failed_pages", "internal_empty_pages", "trailing_empty_pages", "end_confirmed", "healthy", (F.col("healthy") & (F.col("_asked") >= enough) & F.col("end_confirmed")).alias("eligible"))


def translated(names: DataFrame, key: str, name: str, whole: list[DataFrame], words: list[DataFrame], joint: str = "") -> DataFrame:
    """(key, translated): by the first table of `whole` (name, to) that has the name, else word by word, each by the first
    table of `words` (word, to) that has it, an unknown word as it is.  Possessives lose their s, hyphens part words.

    The tables of a kind become one, in their order, so a level more is no join more; each different name and word is looked up once."""

    def first(tables: list[DataFrame]) -> DataFrame:
        every = None
        for level, t in enumerate(tables):
            one = t.toDF("_from", "_to").withColumn("_level", F.lit(level))
            every = one if every is None else every.unionByName(one)
        return every.groupBy("_from").agg(F.min_by("_to", F.struct("_level", "_to")).alias("_to"))

    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace("n", "[’']s\\b", ""), "[’']", ""), "[-–]", " ")
    different = names.select(F.col(name).alias("n")).filter("n IS NOT NULL").distinct()
    known = different.join(first(whole), F.col("n") == F.col("_from"), "left").select("n", F.col("_to").alias("whole"))
    each = known.filter("whole IS NULL").select("n", F.posexplode(F.split(F.trim(plain), r"\s+")).alias("at", "w"))
    met = each.join(first(words), F.col("w") == F.col("_from"), "left").groupBy("n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("_to", "w").alias("to")))), lambda x: x["to"]), joint).alias("_joined"))  # one name's words
    done = known.join(met, "n", "left").select(F.col("n").alias("_n"), F.coalesce("whole", F.nullif("_joined", F.lit("")), "n").alias("translated"))
    return names.join(done, F.col(name) == F.col("_n"), "left").select(key, "translated")
