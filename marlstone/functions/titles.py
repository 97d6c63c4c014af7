"""What a listing's title claims of the account: start season, break class, packages, tier, style, winglessness.

A title is folded to one script and marked by signs; seasons are found by a scan for their names, and a title starts in
a season only if it names no other and what stands beside the name says so.  Packages are read as quantities: bound word,
number, range, plus, label, tail, each with what spoils it; a title with one spoilt quantity states none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions.marks import let, marked, matches, name_of, names_marked, signs_of, single

# Seasons in their order and what they are called.
SEASONS = (
    ("gratitude", "感恩"),
    ("lightseekers", "追光"),
    ("belonging", "歸屬"),
    ("rhythm", "音韻"),
    ("enchantment", "魔法"),
    ("sanctuary", "聖島"),
    ("prophecy", "預言"),
    ("dreams", "夢想"),
    ("assembly", "集結|重組"),
    ("the-little-prince", "小王子|王子"),
    ("flight", "風行|飛行|飛翔"),
    ("abyss", "潛海|深淵"),
    ("performance", "表演"),
    ("shattering", "破碎|破曉"),
    ("aurora", "極光|歐若拉|aurora"),
    ("remembrance", "緬懷|追憶"),
    ("passage", "夜行"),
    ("moments", "拾光|時光季"),
    ("revival", "歸巢|雲巢季"),
    ("nine-colored-deer", "九色鹿"),
    ("nesting", "築巢"),
    ("duets", "協奏|二重奏"),
    ("moomin", "姆明"),
    ("radiance", "染色|彩染"),
    ("blue-bird", "青鳥"),
    ("two-embers-part-1", "雙星季:?暮星篇|暮星篇|暮星"),
    ("migration", "遷徙|遷徒|遷途"),
    ("lightmending", "織光"),
    ("carnival", "狂歡"),
    ("dear-van-gogh", "致梵谷|致梵高|梵谷|梵高"),
)
# The simplified forms of the characters that count here, and the traditional ones, place by place.
SIMPLIFIED = "归属韵圣岛预梦结组风飞潜渊晓极欧缅怀忆时云筑协鸟双迁织欢礼号帐简断无伪适总计余个块币证发饰乐绑业毕备将进状节台烛爱满达过于约沒没并为内应该计"
TRADITIONAL = "歸屬韻聖島預夢結組風飛潛淵曉極歐緬懷憶時雲築協鳥雙遷織歡禮號帳簡斷無偽適總計餘個塊幣證髮飾樂綁業畢備將進狀節台燭愛滿達過於約沒沒並為內應該計"
# A negation of title words; classes, tiers and styles.
NOT = "非|不是|並非|不算|非為"
BREAKS = (("none", "無斷|不斷"), ("slight", "[微小]斷"), ("medium", "中斷"), ("big", "大斷"))
TIERS = (("few", "少禮"), ("medium", "適?中禮"), ("many", "多禮"))
STYLES = (("simple", "簡[號帳]|簡(?=$|[,|])"), ("regular", "普通?[號帳]"))
# Words of package quantities.
PACKAGE_WORDS = (
    ("P", "禮包"),
    ("L", "禮"),
    ("K", "超過"),
    ("A", "至少|最少"),
    ("M", "最多|至多|不超過|不K"),
    ("U", "不到|不滿|未滿|少於"),
    ("G", "沒有|不是|並非|不足|不破|未達|未到|未破|低於|不算|非"),
    ("H", "不一定|大概|大約|可能|估計|應該"),
    ("Y", "近|約"),
    ("T", "共計|總共|共"),
    ("O", "以上"),
    ("B", "以下|以內"),
    ("Z", "左右|上下"),
    ("R", "[-~至到]"),
    ("W", r"(?<=\d)[多餘]"),
    ("C", "個"),
    ("E", "元|塊|台幣|港幣|人民幣|蠟|燭|愛心|件|份|rmb|twd|cny|usd|hkd"),
)
MOST_PACKAGES = 999
# What behind a season's name speaks of an item, of its end, of a package account, of its start.
ITEM = "^季?(?:卡|(?:通行)?證|斗篷|披風|面具|髮型|髮飾|樂器)"
ENDED = "^季?[已全]?(?:畢業|畢)"
ENDED_FOR_SURE = ENDED + "(?![業禮物面斗髮飾琴進狀率度計?])"
ENDED_ASKED = ENDED + "了?[?]"
NOT_ENDED = "(?:非|不|不是|沒|沒有|未|無|可|能|包|代|將|想|準備|預計)[已全]?$"
PACKAGE_ACCOUNT = "^季?(?:綁全出)?禮包(?:[號帳簡]|無翼)"
COUNTED = "^(?:[0-9]+|[一二兩三四五六七八九十]+)季(?:禮包)?[號帳]"
WINGLESS_TRANSFER = "^季?(?:綁全出無翼|無翼綁全出)"
STYLE_BESIDE = "^季?(?:綁全出)?[簡普]"


def folded(title: Column) -> Column:
    """A compact title in traditional characters."""
    return F.translate(title, SIMPLIFIED, TRADITIONAL)


def _claimed(text: Column, claims: tuple[tuple[str, str], ...]) -> Column:
    """The one claim whose words stand there and are nowhere negated; null for none or several."""
    return single(F.array_compact(F.array(*(F.when(text.rlike(words) & ~text.rlike(f"(?:{NOT})(?:{words})"), F.lit(name)) for name, words in claims))))


_QUANTITY = (
    r"(?:([GYUM])([^|,PL百0-9]{0,6})|([GYH])[\p{P}\p{S}]*([UM]?))?"  # what goes before: 1 vague or bound, 2 gap, 3 adjacent, 4 bound
    r"(?:(P):?T?:?(A?)(\d+)(?:R(\d+))?([+W]?)C?([OBZ]?)(?:P(?!\d))?([EOBZWR+.0-9]?)"  # 5 label, 6 at least, 7 number, 8 to, 9 plus, 10 tail, 11 next
    r"|(A?)([+R.]?)(\d+)(?:R(\d+))?([+W]?)C?[PL]([物拜金]|[盒服券品炮])?([OBZ]?)([OBZWR0-9]?)"  # 12 at least, 13 lead, 14 number, 15 to, 16 plus, 17 thing, 18 tail, 19 next
    r"|([半幾數兩二三四五六七八九十]?)(破?)百[PL]([OBZ]?))"  # 20 numeral, 21 over, 22 tail
)
_GROUPS = "v gap beside bound label a1 n1 to1 plus1 tail1 next1 a2 lead n2 to2 plus2 thing tail2 next2 numeral over tail3".split()


def _quantity(m: Column, others: Column) -> Column:
    """struct(kind, low, high, summary) of one quantity: exact, range, or spoilt; others: bounded numbers in the title."""
    number = lambda c: F.nullif(m[c], F.lit("")).try_cast("long")
    n, to = F.coalesce(number("n1"), number("n2")), F.coalesce(number("to1"), number("to2"))
    plus, tail, least = F.concat(m["plus1"], m["plus2"]), F.concat(m["tail1"], m["tail2"]), F.concat(m["a1"], m["a2"])
    labelled, hundred = m["label"] != "", F.concat(m["n1"], m["n2"]) == ""
    ranged = F.concat(m["to1"], m["to2"]) != ""
    bound = ~labelled & ((m["v"].isin("U", "M") & (m["gap"] == "")) | (m["bound"] != ""))
    under = (m["v"] == "U") | (m["bound"] == "U")
    vague = (m["v"] != "") & ~bound | (tail == "Z")
    bad = (m["next1"] != "") | (m["next2"] != "") | m["thing"].isin("物", "拜", "金") | ((plus == "W") & ranged)
    upper = bound | (tail == "B")
    upper_bad = (m["beside"] != "") | (m["thing"] != "") | (plus != "") | ranged | (least != "") | (bound & (tail != "")) | (m["lead"] != "") | (others > bound.cast("int"))
    high = n - F.when(under & bound, 1).otherwise(0)
    lower = (plus != "") | (least != "") | (tail == "O")
    low = n + F.when(plus == "W", 1).otherwise(0)
    of = lambda kind, low, high: F.struct(F.lit(kind).alias("kind"), low.cast("int").alias("low"), high.cast("int").alias("high"), (~hundred & ~lower).alias("summary"))
    none = F.lit(None)
    fits = lambda x: x.between(0, MOST_PACKAGES)
    spoilt = of("spoilt", none, none)
    by_hundred = F.when((m["v"] != "") | (m["bound"] != "") | (m["numeral"] != "") | (m["tail3"] != ""), spoilt).otherwise(of("range", F.when(m["over"] != "", 101).otherwise(100), none))
    return (
        F.when(hundred, by_hundred)
        .when(vague | bad, spoilt)
        .when(upper, F.when(~upper_bad & fits(n) & fits(high), of("range", F.lit(0), high)).otherwise(spoilt))
        .when(lower, F.when(~ranged & fits(low), of("range", low, none)).otherwise(spoilt))
        .when(ranged, F.when(fits(n) & fits(to) & (to >= n), of("range", n, to)).otherwise(spoilt))
        .when(fits(n), of("exact", n, n))
        .otherwise(of("too many", none, none))
    )


def quantities(title: Column) -> Column:
    """An array of all package quantities of a folded title."""
    return let(marked(title, PACKAGE_WORDS), lambda t: let(F.regexp_count(t, F.lit(r"[AUMK]\d")), lambda others: F.transform(matches(t, _QUANTITY, *_GROUPS), lambda m: _quantity(m, others))))


def _start(t: Column, packages: Column, break_class: Column, style: Column) -> Column:
    """The season in which the account starts, from a folded title with its seasons marked; null if it doesn't say."""
    s = signs_of(SEASONS)

    def judged(x: Column) -> Column:
        before, after, sign = x["before"], x["after"], x["sign"]
        package_account = after.rlike(PACKAGE_ACCOUNT)
        starts, ended = after.rlike("^季?起"), after.rlike(ENDED)
        refused = after.rlike(ITEM) | (after.rlike("^禮包") & ~package_account) | (starts & before.rlike("(?:非|不是|並非)季?$"))
        completed = after.rlike(ENDED_FOR_SURE) & ~before.rlike(NOT_ENDED) & ~after.rlike(ENDED_ASKED)
        break_season, moved = t.rlike("斷季"), after.rlike(WINGLESS_TRANSFER)
        account = t.rlike("[號帳]") | style.isNotNull() | break_class.isNotNull() | break_season | package_account | moved
        summary = t.rlike("[少中多]禮") | F.exists(packages, lambda q: q["summary"])
        told = break_class.isNotNull() | summary | break_season | (style.isNotNull() & after.rlike(STYLE_BESIDE)) | after.rlike(COUNTED) | package_account | moved
        claims = starts | before.rlike("(?:起季|起號|入坑)$") | completed | (account & told)
        return F.when((x["seasons"] == 1) & claims & ~refused & (completed | ~ended), name_of(sign, SEASONS))

    part = lambda k: F.regexp_extract(t, f"^([^{s[1:-1]}]*)({s})(.*)$", k)
    return let(F.struct(part(1).alias("before"), part(2).alias("sign"), part(3).alias("after"), F.size(F.array_distinct(F.regexp_extract_all(t, F.lit(f"({s})"), F.lit(1)))).alias("seasons")), judged)


def _list_start(t: Column) -> Column:
    """The earliest season of the one list of finished seasons in a title, if all its items are seasons."""
    s = signs_of(SEASONS)
    lists = F.regexp_extract_all(t, F.lit(r"[【\[]畢業季節[】\]]:?([^【\[]+)"), F.lit(1))
    items = F.filter(F.split(F.get(lists, F.lit(0)), r"[,、|/]+"), lambda x: x != "")
    fine = (F.size(lists) == 1) & (F.size(items) > 0) & F.forall(items, lambda x: x.rlike(f"^{s}季?$"))
    return F.when(fine, name_of(F.array_min(F.transform(items, lambda x: F.substring(x, 1, 1))), SEASONS))


def _english_start(title: Column) -> Column:
    """The first season of a heading that states completed seasons from one to another, and nothing else."""
    pattern = r"^(?:[a-z0-9]+(?:-[a-z0-9]+)+:\s*)?completed\s+([1-9][0-9]?)\s+seasons?\s+from\s+([a-z -]+?)\s+to\s+([a-z0-9 -]+)(?:\.\s*)?$"
    names = F.array(*(F.lit(n.replace("-", " ").removeprefix("the ")) for n, _ in SEASONS))
    plain = lambda k: F.regexp_replace(F.regexp_replace(F.trim(F.regexp_extract(title, pattern, k)), r"[-\s]+", " "), "^(?:season of )?(?:the )?", "")
    first, last = F.array_position(names, plain(2)), F.array_position(names, plain(3))
    count = F.regexp_extract(title, pattern, 1).try_cast("int")
    fine = (first > 0) & (((last > 0) & (last - first + 1 >= count)) | ((last == 0) & (plain(3) == "two embers")))
    return F.when(title.rlike("^[a-z0-9]") & fine, F.get(F.array(*(F.lit(n) for n, _ in SEASONS)), (first - 1).cast("int")))


def title_claims(title: Column) -> Column:
    """struct of a normalised title's start_season, break_class, package_count, package_range (low, high), sale_tier,
    account_style and wingless; what isn't claimed, or claimed twice, is null. A null title claims nothing."""

    def read(t: Column) -> Column:
        break_class = F.when(t.rlike("偽無斷"), "slight").otherwise(_claimed(t, BREAKS))
        tier = F.when(~t.rlike("(?:中少|中多|少中|多中)禮"), _claimed(t, TIERS))
        return let(F.struct(t.alias("t"), break_class.alias("b"), tier.alias("tier"), _claimed(t, STYLES).alias("style"), quantities(t).alias("q"), names_marked(t, SEASONS).alias("s")), told)

    def told(x: Column) -> Column:
        q = x["q"]
        exact = F.forall(q, lambda p: p["kind"].isin("exact", "too many"))
        count = F.when(exact, single(F.transform(F.filter(q, lambda p: p["kind"] == "exact"), lambda p: p["low"])))
        bounds = F.when((F.size(q) == 1) & (F.get(q, F.lit(0))["kind"] == "range"), F.struct(F.get(q, F.lit(0))["low"].alias("low"), F.get(q, F.lit(0))["high"].alias("high")))
        start = F.coalesce(_start(x["s"], q, x["b"], x["style"]), _list_start(x["s"]), _english_start(F.lower(title)))
        return F.struct(
            start.alias("start_season"), x["b"].alias("break_class"), count.alias("package_count"), bounds.alias("package_range"), x["tier"].alias("sale_tier"), x["style"].alias("account_style"),
            (x["t"].rlike("無翼") & ~x["t"].rlike(f"(?:{NOT})無翼")).alias("wingless"),
        )

    nothing = F.lit(None).cast("string")
    bounds = F.lit(None).cast("struct<low:int,high:int>")
    silent = F.struct(nothing.alias("start_season"), nothing.alias("break_class"), F.lit(None).cast("int").alias("package_count"), bounds.alias("package_range"), nothing.alias("sale_tier"), nothing.alias("account_style"), F.lit(False).alias("wingless"))
    worth = title.rlike(r"[\u2E80-\u9FFF]|(?i:completed)|\ufffd")
    return F.when(worth, let(folded(F.regexp_replace(F.lower(title), r"(?U)\s+", "")), read)).otherwise(silent)


def headline(title: Column, listing_title: Column, text: Column) -> Column:
    """The first of the title, the listing's title and the text's lines that isn't blank, a placeholder or a page mark."""
    usable = lambda x: x.isNotNull() & (x != "") & ~x.rlike(r"(?i)^(?:unknown|n/a|null|none|-|分頁\s*[0-9]+)$")
    lines = F.concat(F.array(title, listing_title), F.split(F.coalesce(text, F.lit("")), r"\r?\n", -1))
    stripped = F.transform(lines, lambda x: F.regexp_replace(x, r"(?U)^[\s﻿]+|[\s﻿]+$", ""))
    return F.coalesce(F.get(F.filter(stripped, usable), F.lit(0)), F.lit(""))
