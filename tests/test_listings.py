"""Layout of listings and the features that their summaries state."""

import pytest
from pyspark.sql import functions as F

from marlstone.functions import listings as L
from marlstone.functions.marks import normalised
from marlstone.operators import features, spans


def told(spark, texts, of):
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", of(normalised(F.col("t"))).alias("x")).collect()
    return {r.t: r.x for r in rows}


def test_numbered_offers(spark):
    post, plain, odd = "#代出\n1️⃣\n魔法無斷中禮\n價格43200台\n2️⃣\n魔法微斷中禮\n價格2.8w台", "售\n1. 一個號", "❶甲\n乙\n\n ❷ 丙\n❸"
    got = told(spark, [post, plain, odd, None], L.numbered_offers)
    assert got[post] == ["#代出\n\n魔法無斷中禮\n價格43200台", "#代出\n\n魔法微斷中禮\n價格2.8w台"]
    assert got[plain] == [plain] and got[odd] == ["甲\n乙", "丙"] and got[None] is None


def test_inventory_sections(spark):
    cases = {"追光大傘\r\n✦ 贈號上數據\r\n追光大傘｜白蠟100\r\n無綁\r\n\r\n星夜之傘｜白蠟900": ("追光大傘\n\n星夜之傘｜白蠟900", "追光大傘｜白蠟100\n無綁", "")}
    for title in ("⚝ › 實體徽章", "✦ 實體 STAR 徽章：", "实体徽章:"):
        cases[f"大傘\n{title}\n大傘｜海龜\n公主抱\n\n星夜之傘"] = ("大傘\n\n星夜之傘", "", "大傘｜海龜\n公主抱")
    for text in ("沒有贈號上數據\n追光大傘", "帳號數據\n追光大傘", "贈送禮包\n星夜之傘", "沒有實體徽章\n大傘", "GG 綁全出\n大傘", "實體徽章另售但有大傘\n海龜斗"):
        cases[text] = (text, "", "")
    cases["赠号上数据：\n追光大傘"] = ("", "追光大傘", "")
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", L.inventory_sections(F.col("t")).alias("x")).collect()
    assert {r.t: tuple(r.x) for r in rows} == cases


def test_data_without_an_account(spark):
    got = told(spark, ["僅國際服數據，無本體", "只有数据没有账号本体", "完整帳號，數據見影片", "不是無本體數據", "無本體", None], L.data_only)
    assert list(got.values()) == [True, True, False, False, False, None]


def test_marked_offers(spark):
    page = lambda price, title="▍音韻無斷": f"{title}\n♤ › 音韻┊魔法\n♡ › GG出\n♧ › {price}\n◇ ›"
    cases = {page("7000RMB┊3.3w NTD包仲介"): (33000.0, False, "including_fees"), page("9700NTD秒┊10000NTD包仲介"): (None, True, "including_fees"), page("9400NTD底"): (9400.0, True, "unknown"), page("8500NTD包仲介,9000直出"): (8500.0, True, "including_fees"), page("1000NTD"): (1000.0, False, "unknown"), "no marks 900NTD": (None, True, "unknown"), page("900NTD") + "合售": (900.0, True, "unknown")}
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", L.marked_offer(normalised(F.col("t")), F.lit("else")).alias("x")).collect()
    assert {r.t: (r.x.price, r.x.excluded, r.x.price_basis) for r in rows} == cases
    assert {r.x.title for r in rows} == {"▍音韻無斷", "else"}


MIXED = ("音韻無斷中少禮號", "音韻無斷中偏少禮號", "音韻無斷中多禮號")
HALF = ("音韻半無斷號", "音韻半後無斷號", "魔法音韻跨季，表演不斷、夜行斷")
NO_PROGRESS = ("季節：音韻、魔法", "季卡：音韻", "畢業：音韻斗篷", "畢業：音韻未畢", "畢業：音韻2/3｜音韻1/3", "畢業：音⅔｜魔法畢", "畢業：音韻2/3｜音韻1/3｜魔法畢")
WHOLE, RICH = "#售 #代掛\n\n音韻無斷百禮號\n禮包：王子圍巾", "▍音韻微斷\n♤ › 音韻⅔┊魔法⁰\n♡ GG 出｜NS 不出\n白蠟 900｜愛心 100\n◇ 缺少王子圍巾"
CHEAP, DEAR = (f"裸資源簡號；白蠟 30、愛心 7、無禮包；開價{n}台幣" for n in (50, 50000))
SUMMARIES = (
    WHOLE, "#售\n便宜帳號\n音韻多禮號", "多禮帳；含小王子三件套與斗篷", "#售 #多社\n魔法無斷中禮\n售 43200", "#代掛 #售\n髒號\n魔法無斷中禮\n價格 2.4直 2.2秒", "#售\n魔法無斷中禮\n音韻無斷多禮\n價格另談", "",
    "音韻無斷百禮號 10萬台幣", "不是音韻起，缺王子圍巾", "#售\n畢業：音韻0｜魔法2/3", "#售\n畢業：梵高2/3", *NO_PROGRESS, "畢業：音韻", RICH, "◇ 王子圍巾｜不含王子圍巾｜王子圍巾｜別的",
    "拾光無斷少禮；GG、GC 不出，Apple／FB 全出", "音韻無斷少禮；Apple／FB 解綁", "音韻多禮號 白蠟900+ 愛心1萬 60+禮 3800台幣 王子圍巾", CHEAP, DEAR, "普通號，沒有禮包；100台", "#代掛 #售號\n﴾ 73 ﴿ 蠟燭簡號\n售價200台幣", "不是蠟燭簡號", "普通號\n其他人售蠟燭簡號", *MIXED, *HALF,
)
KNOWN = {"known": ("音韻無斷百禮號", "enchantment", "large", None, None), "seen": ("音韻無斷多禮號", None, None, None, ["season"]), "progress seen": ("畢業：音韻", None, None, None, ["season"]), "null": (None, None, None, None, None)}


@pytest.fixture(scope="module")
def read(spark):
    """What is read from all summaries, by their text, or by their name if fields are known."""
    items = spans.dictionary(spark.createDataFrame([("王子圍巾", "official-1")], "n string, i string"), "n", "i")
    rows = [(t, t, None, None, None, None) for t in SUMMARIES] + [(k, *v) for k, v in KNOWN.items()]
    df = spark.createDataFrame(rows, "k string, summary string, season string, break_class string, package_tier string, reviewed array<string>")
    return {r.k: r for r in features.filled(df, "k", items).collect()}


def basic(r):
    return r.season, r.break_class, r.package_tier


def test_headings(read):
    assert basic(read[WHOLE]) == ("rhythm", "none", "hundred") and read["#售\n便宜帳號\n音韻多禮號"].season is None and read["多禮帳；含小王子三件套與斗篷"].season is None
    assert basic(read["#售 #多社\n魔法無斷中禮\n售 43200"]) == basic(read["#代掛 #售\n髒號\n魔法無斷中禮\n價格 2.4直 2.2秒"]) == ("enchantment", "none", "medium")
    assert basic(read["#售\n魔法無斷中禮\n音韻無斷多禮\n價格另談"]) == basic(read[""]) == basic(read["null"]) == (None, None, None)
    assert [(c.field, c.after, c.quote) for c in read[WHOLE].corrections] == [(f, v, "音韻無斷百禮號") for f, v in (("season", "rhythm"), ("breakClass", "none"), ("packageTier", "hundred"))]


def test_nothing_known_or_reviewed_is_overridden(read):
    assert basic(read["音韻無斷百禮號 10萬台幣"]) == ("rhythm", "none", "hundred") and basic(read["known"]) == ("enchantment", "large", "hundred")
    assert read["seen"].season is None and read["seen"].break_class is None and read["不是音韻起，缺王子圍巾"].season is None


def test_progress(read):
    r, other = read["#售\n畢業：音韻0｜魔法2/3"], read["#售\n畢業：梵高2/3"]
    assert r.season == "enchantment" and r.break_class is None and (float(r.features["progress:rhythm"]), float(r.features["progress:enchantment"])) == (0, 2 / 3)
    assert other.season == "dear-van-gogh" and float(other.features["progress:dear-van-gogh"]) == 2 / 3
    assert [t for t in (*NO_PROGRESS, "progress seen") if read[t].season is not None] == [] and read["畢業：音韻"].season == "rhythm"


def test_features_with_their_quotes(read):
    r, clash = read[RICH], read["◇ 王子圍巾｜不含王子圍巾｜王子圍巾｜別的"]
    f = r.features
    assert float(f["progress:rhythm"]) == 2 / 3 and float(f["progress:enchantment"]) == 0 and f["item:official-1"] == "absent" and (f["candles"], f["hearts"]) == ("900", "100")
    assert (f["binding:GG"], f["binding:NS"]) == ("transferable", "不出") and "binding:PSN" not in f and all(r.evidence.values()) and r.evidence.keys() == f.keys()
    assert clash.features["item:official-1"] is None and "CONFLICT" in clash.evidence["item:official-1"] and clash.unresolved == ["別的"]


def test_bindings_and_resources(read):
    assert read["拾光無斷少禮；GG、GC 不出，Apple／FB 全出"].features == {"binding:GG": "不出", "binding:GC": "不出", "binding:APPLE": "transferable", "binding:FB": "transferable"}
    assert read["音韻無斷少禮；Apple／FB 解綁"].features == {"binding:APPLE": "unbound", "binding:FB": "unbound"} and read["音韻多禮號 白蠟900+ 愛心1萬 60+禮 3800台幣 王子圍巾"].features == {}


def test_styles_tiers_and_no_packages(read):
    assert read[CHEAP].features == read[DEAR].features == {"accountStyle": "resource", "candles": "30", "hearts": "7"} and read["普通號，沒有禮包；100台"].features["packageCount"] == "0"
    plain = read["#代掛 #售號\n﴾ 73 ﴿ 蠟燭簡號\n售價200台幣"]
    assert plain.features == {"accountStyle": "resource"} and plain.season is None and read["不是蠟燭簡號"].features.get("accountStyle") != "resource" and read["普通號\n其他人售蠟燭簡號"].features["accountStyle"] == "regular"
    assert all(read[t].package_tier is None for t in MIXED) and all(read[t].break_class is None for t in HALF)
