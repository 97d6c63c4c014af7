"""Features of account listings: what a summary states fills what isn't known, with the words that say so.

The heading is the marked line (▍), else the first line that isn't a posting label; a heading that doesn't state season,
break class and tier gives way to the one line among the first twelve that does, and to none if several do.  A claim
fills only a null that no review has looked at.  Features beside these are package count, style, progress by season,
resources, bindings and items; a feature stated in two ways is null, and its quote says so.

Cases: a null summary states nothing; unknown names in `reviewed` count for nothing; rows of one key are separate rows
for all but items, which are joined by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.listings import between, lines_of
from marlstone.functions.marks import let, name_of, names_marked, normalised, signs_of, single
from marlstone.functions.titles import SEASONS, folded, title_claims
from marlstone.operators.spans import form

# Posting labels; lines of progress; words of a resource account, of no packages; resources; platforms.
LABELS = r"^(?:(?:[#＃]\s*)?(?:售|出售|售號|售号|賣號|卖号|緩售|缓售|代售|代掛|代挂|已售|已售出|急售|收|求購|求购|多社)[\s,，、]*)+$"
PROGRESS = r"^(?:✦\s*)?(?:畢業季節|毕业季节|畢業|毕业|季節進度|季节进度)\s*[:：]"
RESOURCE_STYLE, DENIED = "((?:純|裸)?(?:資源|资源|蠟燭|蜡烛|白蠟|白蜡)(?:簡|简)(?:號|号))", r"(?:不是|並非|并非|不算|非)\s*$"
NO_PACKAGES = r"(?:^|[\s；;，,。｜|])((?:無|没有|沒有)禮包)(?=[\s；;，,。｜|]|$)"
MIXED_TIERS, HALF = "中(?:偏)?[少多][禮礼]|中[禮礼][少多]|[少多]中[禮礼]", "半(?:後|后)?[無无]斷"
HUNDRED, NOT_HUNDRED = "百[禮礼]", "(?:非|不|無|无|沒有|未達|不到)百[禮礼]"
RESOURCES = (("candles", "白蠟|白蜡"), ("hearts", "愛心|爱心"), ("ascended", "昇華蠟|升華蠟|升华蜡"), ("passes", "副卡"))
PLATFORMS = ("GG", "GC", "NS", "PSN", "STEAM", "FB", "APPLE")
STATUS = "(未綁|無綁|解綁|可換綁|不出|可出|全出|出|遺失|異常)"
ITEM_HEADS, ITEM_CUTS, ABSENT = "✦ (?:限定聯動|重要禮包|特殊限定)", "[\r\n┊｜|・⸝╻›、,，;；]+", "^(?:沒有|缺少|不含|無)"
TITLE_LINES = 12


def _feature(name: Column, value: Column, quote: Column) -> Column:
    return F.struct(name.cast("string").alias("name"), value.cast("string").alias("value"), quote.cast("string").alias("quote"))


_KIND = "array<struct<name:string,value:string,quote:string>>"


def _some(*features: Column) -> Column:
    return F.array_compact(F.array(*features))


def _heading(lines: Column) -> Column:
    """The line that speaks for the account."""
    short = lambda x: F.trim(F.split(x, "[；;]")[0])
    free = F.filter(lines, lambda x: ~x.rlike(LABELS))
    marked = F.get(F.filter(lines, lambda x: F.contains(x, F.lit("▍"))), F.lit(0))
    complete = lambda x: let(title_claims(x), lambda c: c["start_season"].isNotNull() & c["break_class"].isNotNull() & c["sale_tier"].isNotNull())
    first = F.coalesce(short(F.coalesce(marked, F.get(free, F.lit(0)))), F.lit(""))
    told = F.array_distinct(F.filter(F.transform(F.filter(F.slice(lines, 1, TITLE_LINES), lambda x: ~short(x).rlike(LABELS)), short), complete))
    return let(F.struct(first.alias("first"), told.alias("told")), lambda h: F.when(F.size(h["told"]) > 1, "").when((F.size(h["told"]) == 1) & ~complete(h["first"]), F.get(h["told"], F.lit(0))).otherwise(h["first"]))


def _progress(text: Column, lines: Column) -> Column:
    """struct(features, complete): how far each season is, in the marked block (♤ to ♡) and lines of progress."""
    stated = F.transform(F.filter(lines, lambda x: x.rlike(PROGRESS)), lambda x: F.regexp_replace(x, "^[^:：]*[:：]", ""))
    parts = F.filter(F.concat(F.array(between(text, "♤", "♡")), stated), lambda x: x != "")
    tokens = F.filter(F.transform(F.flatten(F.transform(parts, lambda x: F.split(x, "[┊|｜、,，\r\n]", -1))), lambda x: F.trim(F.regexp_replace(x, r"^[\s›]+", ""))), lambda x: x != "")
    s = signs_of(SEASONS)

    def claim(token: Column) -> Column:
        signs = names_marked(folded(F.lower(F.regexp_replace(token, r"\s+", ""))), SEASONS)
        done, of = (F.regexp_extract(signs, f"^{s}季?([0-9]+)[/⁄]([1-9][0-9]*)$", k).try_cast("double") for k in (1, 2))
        value = F.when(signs.rlike(f"^{s}季?(?:畢|畢業|全畢)?$"), 1.0).when(signs.rlike(f"^{s}季?(?:0|∅|未畢)$"), 0.0).when(done <= of, done / of)
        return F.struct(F.when(value.isNotNull(), name_of(F.substring(signs, 1, 1), SEASONS)).alias("season"), value.alias("value"), token.alias("token"))

    def told(claims: Column) -> Column:
        known = F.filter(claims, lambda c: c["season"].isNotNull())

        def of(season: str) -> Column:
            mine = F.filter(known, lambda c: c["season"] == season)
            one = single(F.transform(mine, lambda c: c["value"]))
            quotes = F.array_join(F.transform(mine, lambda c: c["token"]), " | CONFLICT: ")
            return F.when(F.size(mine) > 0, _feature(F.lit(f"progress:{season}"), one, F.when(one.isNotNull(), F.get(mine, F.lit(0))["token"]).otherwise(quotes)))

        return F.struct(_some(*(of(slug) for slug, _ in SEASONS)).alias("features"), ((F.size(claims) > 0) & (F.size(known) == F.size(claims))).alias("complete"))

    return let(F.transform(tokens, claim), told)


def _bindings(text: Column) -> Column:
    names = "|".join(PLATFORMS)
    meaning = lambda s: F.when(s.rlike("未綁|無綁|解綁|可換綁"), "unbound").when(s.rlike("可出|全出|^出$"), "transferable").otherwise(s)
    shared = rf"(?i)\b((?:{names})(?:\s*[、,，/／]\s*(?:{names})){{1,6}})\s*(?:前號|前任)?\s*(?:綁定)?\s*[:：]?\s*{STATUS}(?!\p{{L}})"
    groups = F.arrays_zip(*(F.regexp_extract_all(text, F.lit(shared), F.lit(k)).alias(n) for k, n in ((0, "quote"), (1, "names"), (2, "status"))))

    def of(name: str) -> Column:
        alone = rf"(?i)\b{name}[ ：:]*{STATUS}(?!\p{{L}})"
        own = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(alone), F.lit(1)), meaning))
        group = F.element_at(F.filter(F.concat(F.array(F.lit(None).cast("struct<quote:string,names:string,status:string>")), groups), lambda g: g.isNull() | g["names"].rlike(rf"(?i)\b{name}\b")), -1)
        one = F.when(F.size(own) == 1, F.get(own, F.lit(0)))
        value = F.coalesce(one, F.when(group.isNotNull(), meaning(group["status"])))
        return F.when(value.isNotNull(), _feature(F.lit(f"binding:{name}"), value, F.when(one.isNotNull(), F.regexp_extract(text, alone, 0)).otherwise(group["quote"])))

    return _some(*(of(name) for name in PLATFORMS))


def _resources(text: Column) -> Column:
    def of(key: str, words: str) -> Column:
        pattern = rf"(?:{words})[ ：:]*([0-9][0-9,]*)(?![0-9,.+＋萬万千])(?=[\s｜|┊・，,、。;；]|$)"
        one = single(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: F.replace(x, F.lit(",")).try_cast("long")))
        return F.when(one.isNotNull(), _feature(F.lit(key), one, F.regexp_extract(text, pattern, 0)))

    return _some(*(of(*r) for r in RESOURCES))


def filled(rows: DataFrame, key: str, items: DataFrame | None = None) -> DataFrame:
    """From (key, summary, season, break_class, package_tier, reviewed: array of field names): the three fields filled,
    features (map of name to value), evidence (map of name to quote), corrections (array of field, after, quote) and
    unresolved (inventory words that are no item's name).

    items: (term, items) as of `spans.dictionary`; a word counts as an item if it is the name of one alone."""
    free = lambda f: ~F.array_contains(F.coalesce("reviewed", F.array().cast("array<string>")), f)
    d = rows.select(key, "season", "break_class", "package_tier", "reviewed", F.coalesce(normalised(F.col("summary")), F.lit("")).alias("t"))
    d = d.withColumn("lines", F.filter(F.transform(lines_of(F.col("t")), lambda x: F.trim(x)), lambda x: x != ""))
    d = d.withColumn("heading", _heading(F.col("lines"))).withColumns({"c": title_claims(F.when(~F.col("heading").rlike(PROGRESS), F.col("heading")).otherwise("")), "p": _progress(F.col("t"), F.col("lines"))})
    h, c, t = F.col("heading"), F.col("c"), F.col("t")
    d = d.withColumn("s1", F.when(F.col("season").isNull() & free("season"), c["start_season"]))
    season = F.coalesce("season", "s1")
    d = d.withColumn("b1", F.when(F.col("break_class").isNull() & free("breakClass") & (c["start_season"] == season) & ~h.rlike(HALF), F.when(c["break_class"] == "big", "large").otherwise(c["break_class"])))
    hundred = h.rlike(HUNDRED) & ~h.rlike(NOT_HUNDRED)
    d = d.withColumn("t1", F.when(F.col("package_tier").isNull() & free("packageTier") & ~h.rlike(MIXED_TIERS), F.when(hundred, "hundred").otherwise(c["sale_tier"])))
    begun = F.get(F.filter("p.features", lambda f: f["value"].cast("double") > 0), F.lit(0))
    whole = F.col("p.complete") & F.forall("p.features", lambda f: f["value"].isNotNull())
    d = d.withColumn("s2", F.when(season.isNull() & free("season") & whole, begun))
    style = F.regexp_extract(h, RESOURCE_STYLE, 1)
    plain = (style != "") & ~F.regexp_extract(h, f"(?s)^(.*?){RESOURCE_STYLE}", 1).rlike(DENIED)
    none = F.regexp_extract(t, NO_PACKAGES, 1)
    count = F.when(none != "", _feature(F.lit("packageCount"), F.lit(0), none)).when(c["package_count"].isNotNull(), _feature(F.lit("packageCount"), c["package_count"], h))
    styled = F.when(plain, _feature(F.lit("accountStyle"), F.lit("resource"), style)).when(c["account_style"].isNotNull(), _feature(F.lit("accountStyle"), c["account_style"], h))
    d = d.withColumn("features", F.concat(_some(count, styled), F.col("p.features"), _resources(t), _bindings(t)).cast(_KIND))
    change = lambda field, after, quote: F.when(after.isNotNull(), F.struct(F.lit(field).alias("field"), after.cast("string").alias("after"), quote.alias("quote")))
    second = F.regexp_replace(F.col("s2.name"), "^progress:", "")
    corrections = _some(change("season", F.col("s1"), h), change("breakClass", F.col("b1"), h), change("packageTier", F.col("t1"), h), change("season", second, F.col("s2.quote")))
    inventory = F.when(F.contains(t, F.lit("◇")), F.get(F.split(t, "◇", -1), F.lit(1))).otherwise(F.array_join(F.slice(F.split(t, ITEM_HEADS, -1), F.lit(2), F.size(F.split(t, ITEM_HEADS, -1))), "\n"))
    words = F.filter(F.transform(F.split(inventory, ITEM_CUTS, -1), lambda x: F.trim(x)), lambda x: x != "")
    d = d.select(key, F.coalesce(season, second).alias("season"), F.coalesce("break_class", "b1").alias("break_class"), F.coalesce("package_tier", "t1").alias("package_tier"), "features", corrections.alias("corrections"), words.alias("words"))
    if items is not None:
        each = d.select(F.col(key).alias("_k"), F.posexplode("words").alias("at", "word")).withColumn("term", form(F.regexp_replace("word", ABSENT, "")))
        only = items.filter(F.size("items") == 1).select("term", F.get("items", F.lit(0)).cast("string").alias("item"))
        met = each.join(only, "term", "left").withColumn("value", F.when(F.col("word").rlike(ABSENT), "absent").otherwise("present"))
        one = met.filter("item IS NOT NULL").groupBy("_k", "item").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.min_by("word", "at").alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " | CONFLICT: ").alias("all"))
        named = one.groupBy("_k").agg(F.array_sort(F.collect_list(_feature(F.concat(F.lit("item:"), "item"), F.when(F.col("lo") == F.col("hi"), F.col("lo")), F.when(F.col("lo") == F.col("hi"), F.col("first")).otherwise(F.col("all"))))).alias("_items"))
        left = met.filter("item IS NULL").groupBy("_k").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]).alias("_left"))  # one summary's words
        d = d.join(named, F.col(key) == F.col("_k"), "left").drop("_k").join(left, F.col(key) == F.col("_k"), "left").drop("_k")
        d = d.withColumn("features", F.concat("features", F.coalesce("_items", F.array().cast(_KIND)))).withColumn("words", F.coalesce("_left", F.array().cast("array<string>"))).drop("_items", "_left")
    pairs = lambda what: F.map_from_entries(F.transform("features", lambda f: F.struct(f["name"], f[what])))
    return d.select(key, "season", "break_class", "package_tier", pairs("value").alias("features"), pairs("quote").alias("evidence"), "corrections", F.col("words").alias("unresolved"))
