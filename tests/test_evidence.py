"""Listing evidence on small texts: what is claimed, and what only looks like a claim."""

import time

import pytest
from pyspark.sql import functions as F

from marlstone.functions import evidence as E
from marlstone.functions import titles as T
from marlstone.functions.marks import normalised

PRICES = {
    "4300直、4100秒": (4100, "quick"), "售 3.8萬台": (38000, "ask"), "價格 6.8台緩出": (68000, "ask"), "價格 5100ntd": (5100, "ask"), "價格:7000 底7400秒 7600直": (7400, "quick"),
    "#代出\n1\n魔法無斷中禮\n價格43200台": (43200, "ask"), "價格2.8w台": (28000, "ask"), "#售\n小王子無斷多禮號\nGG 不出\n8000": (8000, "ask"), "售 12,500": (12500, "ask"), "預算: 3000元": None,
    "售魔法號 4300 或 4100": None, "售4300 售4100": None, "白蠟 3000元": None, "12500期": None, "3000個月": None, "售 300": None, "售 2000000": None, "nothing": None, "": None,
}

ENCHANTED = ("禮包60多", "禮包60餘", "礼包60余", "60多禮", "60餘個禮包", "60余个礼包", "禮包共計60多")
ABOUT = ("約80禮", "近80個禮包", "80禮左右", "80個禮包上下", "非80禮", "禮包：80左右")
MOST = {"不到80禮": 79, "不滿80禮包": 79, "不到60禮包": 59, "未满８０个礼包": 79, "少於15禮": 14, "最多50禮": 50, "至多80個禮包": 80, "不超過80禮包": 80, "80禮以下": 80, "80个礼包以内": 80, "最多0禮": 0}
#: The exact number, or the bounds, or nothing.
PACKAGES = {
    **{t: 80 for t in ("禮包共80", "禮包共計：80", "礼包总共80", "禮包總共８０", "禮包80", "80禮包", "80禮", "80個禮包", "80个礼包", "禮包：80", "礼包:80", "８０個禮包", "魔法起80個禮包", "拾光80個禮包號", "魔法無斷80禮+千蠟", "魔法無斷80禮百蠟", "魔法季起無斷80禮包", "80禮｜禮包80")},
    "60個禮包+900蠟": 60, "魔法季起無斷禮包90": 90,
    **{t: (80, None) for t in ("禮包共計80以上", "禮包總共80個以上")},
    **{t: (61, None) for t in ENCHANTED}, **{f"魔法起{t}": (61, None) for t in ENCHANTED},
    **{t: (60, None) for t in ("禮包：60+", "60+個禮包", "60+个礼包", "６０＋ 個禮包", "60禮以上", "60個禮包以上", "至少60禮包", "最少60个礼包", "禮包至少60", "礼包最少60", "６０ 禮包以上", "60+禮包", "禮包60+", "魔法起60+個禮包")},
    **{t: (60, 80) for t in ("60～80個禮包", "禮包：60～80", "礼包60-80", "禮包 60 至 80 個", "禮包60到80禮包", "禮包６０～８０", "60～80禮")},
    "１００＋个礼包": (100, None), "破百禮": (101, None), "魔法無斷百禮": (100, None), "音韻斷季70+禮": (70, None),
    **{t: (100, None) for t in ("不死鳥百禮", "不刀百禮", "不議價百禮")},
    **{t: (0, 80) for t in ("禮包80個以下", "禮包80以下", "礼包：８０个以内", "禮包 80 以內")}, **{t: (0, 50) for t in ("最多50禮+900蠟", "千翼+最多50禮")},
    **{t: (0, n) for t, n in MOST.items()}, **{f"魔法起{t}": (0, n) for t, n in MOST.items()},
    **{t: None for t in (
        "不是60多禮", "約禮包60多", "禮包60餘左右", "60多禮｜80禮", "999多禮", "禮包999多", "禮包60多元", "禮包共80元", "礼包共计80rmb", "禮包60-80多", "60到80多禮", "禮包60多-80", "禮包60多到80", "禮包60餘至80", "禮包共80台幣", "禮包共80港幣", "禮包共80人民幣",
        "禮包總共80蠟燭", "禮包60餘蠟燭", "禮包共計80愛心", "禮包60多件", "禮包共80份", "60多禮物", "60多禮拜", "60餘禮金", "不是禮包共80", "非禮包總共80", "不算禮包共計80", "沒有禮包共80", "不到禮包共80",
        *ABOUT, *(f"魔法起{t}" for t in ABOUT), "約60+個禮包", "60+個禮包左右", "未滿100+個禮包", "60+個禮包 90個禮包", "60+個禮包 100+個禮包",
        "不到百禮", "百禮以下", "百禮左右", "二百禮", "100+禮 80禮", "60～80禮 100禮", "未滿100+禮", "不破百禮", "最多百禮", "至多百禮", "未達百禮", "不超過百禮",
        "禮包80-60", "禮包60-1000", "約禮包60-80", "禮包60-80左右", "禮包60-80｜90禮包", "禮包60-80｜禮包100-120",
        "不是至少60禮包", "沒有60禮以上", "約60禮以上", "至少60禮包左右", "60～80禮以上", "禮包60～80以上", "至少1000禮包", "至少60禮包｜80禮包",
        "不是禮包80個以下", "約禮包80個以下", "禮包80個以下左右", "禮包80以下｜90禮", "禮包80元以下", "禮包80件以下", "禮包80-90以下", "禮包1000個以下",
        "不是，不到80禮", "沒有：最多80禮", "並非「80禮以下」", "約：最多80禮", "最多80禮盒", "最多80禮服", "最多80禮券", "最多80禮品", "最多80禮炮", "60+80禮以下", "至少20但最多10禮", "超過20但最多10禮", "不到20但最多10禮", "最多10禮但至少20", "估計最多80禮", "應該不到80禮", "不是【最多80禮】",
        "不到0禮", "最多1000禮", "最多80禮物", "最多80禮金", "最多80元", "不是不到80禮", "約最多80禮", "80禮以下左右", "最多80禮以上", "60～80禮以下", "最多80禮｜90禮", "不到80禮｜至少60禮", "最多80禮包左右", "未滿80+禮", "60+禮｜80禮以下", "60多個禮包｜最多80禮", "不一定最多80禮", "大概最多80禮",
        "近百禮", "百蠟", "60+禮 90+禮", "80禮物", "禮包80元", "", "禮包80｜禮包90", "魔法季起無斷1800禮", "魔法季起無斷 5200 元", "魔法季起無斷 80禮 90禮",
    )},
}

#: start season, break class, tier, style, wingless.
TITLES = {
    "魔法起微斷少禮號": ("enchantment", "slight", "few", None, False), "不是無斷": (None, None, None, None, False), "大斷小斷": (None, None, None, None, False), "中少禮號": (None, None, None, None, False), "普號無翼": (None, None, None, "regular", True), "大斷 適中禮 普通帳": (None, "big", "medium", "regular", False),
    "拾光微斷多禮號": ("moments", "slight", "many", None, False), "魔法季起無斷80禮": ("enchantment", "none", None, None, False), "表演大斷簡號 無翼": ("performance", "big", None, "simple", True), "拾光微斷少禮號": ("moments", "slight", "few", None, False),
    "狂歡簡, 極限身高可14.28": ("carnival", None, None, "simple", False), "千蠟表演斷季無翼": ("performance", None, None, None, True), "飛行偽無斷綁全出": ("flight", "slight", None, None, False), "深淵偽無斷": ("abyss", "slight", None, None, False),
    "青鳥無斷綁全出": ("blue-bird", "none", None, None, False), "協奏小斷禮包號": ("duets", "slight", None, None, False), "不是無斷的拾光號": (None, None, None, None, False), "非無翼拾光微斷號": ("moments", "slight", None, None, False), "拾光微斷中斷號": (None, None, None, None, False),
    "非簡號 魔法季起無斷": ("enchantment", "none", None, None, False), "魔法季起無斷少禮多禮號": ("enchantment", "none", None, None, False), "預言偽無斷中少禮號": ("prophecy", "slight", None, None, False), "拾光無斷中多禮號": ("moments", "none", None, None, False),
    **{t: ("rhythm", None, None, "simple", False) for t in ("音韻綁全出簡", "音韵季绑全出简号", "音韻綁全出簡帳")},
}
STARTS = {
    **{f"魔法起{t}": "enchantment" for t in (*ENCHANTED, *ABOUT, *MOST)}, "拾光80個禮包號": "moments",
    **{t: None for t in ("姆明毕业礼多礼号", "不是姆明毕业多礼号", "姆明毕业面具少礼号", "姆明畢業進度中禮號", "姆明畢業？多禮號")},
    "光遇姆明季毕业": "moomin", "安卓开服号，圣岛季毕业，多复刻，价格可议": "sanctuary", "童真面具狂欢毕业永久无翼": "carnival", "14号身高欧若拉毕业有绊爱": "aurora", "姆明已畢業": "moomin", "姆明畢": "moomin",
    **{t: None for t in ("有姆明毕业礼可看截图", "迁徙毕业面具", "姆明畢業斗篷", "姆明毕业发型", "姆明畢業進度", "姆明可畢業", "姆明未畢業", "非姆明畢業", "沒有姆明畢業", "代姆明畢業", "預計姆明畢業", "姆明畢業？", "姆明畢業了？", "姆明季卡畢業號", "預言季聖島季畢業")},
    **{t: "performance" for t in ("【毕业季节】：表演季，破晓季，欧若拉季，追忆季，夜行季，狂欢季【毕业物品】：白枭发", "[畢業季節]:狂歡／表演季／極光季", "【毕业季节】：狂欢季，表演季，")},
    **{t: None for t in ("【毕业季节】：", "【毕业季节】：表演季卡，狂欢季", "【未毕业季节】：表演季，狂欢季", "【毕业地图】：表演季，狂欢季", "【毕业季节】：表演面具，狂欢季", "【毕业季节】：表演季，未知季", "【毕业季节】：表演季【毕业季节】：狂欢季")},
    "SCOTL-P03: Completed 7 seasons from Passage to Two Embers.": "passage", "SCOTL-P04: Completed 4 seasons from Duets to Blue Bird.": "duets", "SCOTL-P11: Completed 14 seasons from Performance to Carnival.": "performance", "Completed 2 seasons from Season of the Little Prince to Flight": "the-little-prince",
    **{t: None for t in (
        "Not completed 4 seasons from Duets to Blue Bird.", "Will have completed 4 seasons from Duets to Blue Bird.", "Completed season passes from Duets to Blue Bird.", "Completed 0 seasons from Duets to Blue Bird.", "Completed 4 seasons from Duets cape to Blue Bird.", "Completed 4 seasons from Carnival to Duets.",
        "Completed 99 seasons from Duets to Blue Bird.", "Completed 4 seasons from Two Embers to Carnival.", "SCOTL-P10: Completed 23 seasons from Rhymth to Carnival. Rhythm 50% (only mask)", "Completed 4 seasons from Duets to Blue Bird. Not actually completed.",
        "Completed 4 seasons from Duets to Blue Bird. Completed 7 seasons from Passage to Carnival.", "Passage to Two Embers account", "Flight cape", "Duets instrument account",
    )},
    **{f"{n}起少禮號": "two-embers-part-1" for n in ("雙星季：暮星篇", "双星季:暮星篇", "雙星季暮星篇", "暮星篇")}, **{f"{n}{x}": None for n in ("雙星季：暮星篇", "双星季:暮星篇", "雙星季暮星篇", "暮星篇") for x in ("季卡少禮號", "斗篷少禮號", "面具少禮號")},
    **{t: None for t in ("雙星動畫", "雙星第二篇起少禮號", "雙星季第二部起少禮號", "雙星季：暮星篇起｜遷徙起少禮號", "二重奏彩染少禮號")},
    **{f"{a}起微斷少禮號": s for s, names in {"shattering": ("破碎", "破曉", "破晓"), "aurora": ("極光", "歐若拉", "欧若拉", "AURORA"), "remembrance": ("緬懷", "追憶", "追忆"), "duets": ("協奏", "二重奏"), "radiance": ("染色", "彩染")}.items() for a in names},
    **{f"{a}{x}": None for a in ("破曉", "破晓", "歐若拉", "欧若拉", "AURORA", "追憶", "追忆", "二重奏", "彩染") for x in ("季卡禮包號", "斗篷禮包號", "面具禮包號")},
    "預言八季禮包號": "prophecy", "預言12季禮包號": "prophecy", "音韻七季禮包號": "rhythm", "協奏兩季禮包號": "duets", "狂歡禮包號": "carnival", "織光禮包無翼": "lightmending", "姆明綁全出無翼": "moomin", "極光綁全出禮包無翼": "aurora", "遷途禮包簡": "migration", "遷徒微斷號": "migration",
    **{t: None for t in ("狂歡禮包", "預言季卡禮包號", "姆明斗篷禮包號", "王子飞行白梟", "緬懷狂歡禮包號", "王子三件套禮包號", "王子圍巾斗禮包號", "姆明耳尾禮包號", "極光金翅膀禮包號", "預言阿努面具禮包號", "姆明耳尾綁全出無翼")},
    **{t: None for t in ("音韻季卡綁全出簡", "音韻吉他綁全出簡", "王子圍巾綁全出簡", "音韻綁全出簡｜追光簡", "音韻綁全出非簡號", "王子三件套禮包簡", "姆明耳尾禮包簡", "極光金翅膀禮包簡", "遷途武士褲禮包簡")},
    **{f"{a}起微斷少禮號": s for s, names in {"flight": ("飛翔季", "飞翔季"), "moments": ("時光季", "时光季"), "revival": ("雲巢季", "云巢季")}.items() for a in names}, **{f"{a}{x}": None for a in ("飛翔季", "飞翔季", "時光季", "时光季", "雲巢季", "云巢季") for x in ("卡多禮號", "斗篷少禮號")},
    **{t: None for t in ("雲巢家具多禮號", "美好時光少禮號", "時光季微斷｜飛翔季無斷號", "歸屬季卡 80禮", "追光斗篷｜歸屬面具 80禮", "追光微斷｜歸屬無斷號", "表演季卡大斷簡號", "一般物品：表演面具 大斷簡號", "非魔法起季 無斷80禮號", "拾光斗篷少禮號", "夢想半重組斷季", "耳墜", "白鳥", "阿努", "白鳥髮型", "阿努面具")},
    "風行季起無斷多禮號": "flight", "集結中斷普號": "assembly", "極光季起無斷": "aurora", "梵高季起微斷": "dear-van-gogh", "拾光少禮號": "moments", "王子斷季百蠟": "the-little-prince", "音韻斷季70+禮": "rhythm",
}

WHOLE = {
    **{t: "none" for t in ("帳號無綁｜可直接改密碼", " 無綁 ｜可直接改密碼", "無綁 可直接改密碼")},
    **{t: "transfer" for t in ("綁全出｜售後不退", "表演無斷無翼綁全出", "ɢɢ綁全出", "綁全出重組斷季百蠟", "ɢɢ,ɴs綁全出", "姆明綁全出無翼", "價格大概\n綁全出", "綁全出\n待確認價格", "綁全出 待確認價格", "綁全出 不確定售價", "綁全出 待核實資源")},
    **{t: None for t in (
        "GG 出｜NS 不出", "無綁｜GG 不出", "無綁｜已綁 Google 可出", "綁全出｜無綁", "不是綁全出", "並非綁定全可出", "不是 綁全出", "非  綁皆出", "無綁｜GG綁出", "無綁｜Nintendo 綁可出", "無綁｜GG：綁出", "無綁定問題", "GG 無綁", "其餘 無綁", "帳號無綁｜NS可出", "綁全出｜GC不出",
        "帳號無綁｜GG可出/不出", "帳號無綁｜GG無綁/已綁", "帳號無綁｜GG無綁/有綁", "綁全出嗎", "綁全出？", "是否綁全出", "請問綁全出嗎？", "不確定綁全出", "請問：綁全出", "是否：綁全出", "不確定：綁全出", "綁全出現", "無綁 嗎", "無綁？", "綁全出｜GG、NS不出",
        "綁全出 待確認", "綁全出（不確定）", "無綁 不確定", "可能綁全出", "應該綁全出", "據說綁全出",
    )},
}
G, N, C = "google", "nintendo", "gameCenter"
PLATFORMS = {
    "GG,ID遺失｜NS可出｜其餘無綁": ({N: "transfer"}, set()), "Ⱄ綁定║gg gc不出⸝st換綁": ({G: "keep", C: "keep"}, set()), "Google 遺失｜FB未綁｜PSN:出": ({G: "issue", "facebook": "none", "playstation": "transfer"}, set()),
    **{t: ({}, set()) for t in ("不是GG可出", "請問 GG可出", "請問：GG可出", "是否 GG可出", "可否 GG可出", "不確定 GG可出", "GG可出嗎", "GG可出 嗎", "GG可出？", "GG可出現", "Apple ID可出", "GG可出但不出", "")},
    "GG、NS不出｜GG,GC可出": ({N: "keep", C: "transfer"}, {G}), "GG Game Center可出": ({G: "transfer", C: "transfer"}, set()), "GG可出,NS不出": ({G: "transfer", N: "keep"}, set()), "GG、NS可出/不出": ({}, {G, N}), "帳號無綁｜GG、NS可出": ({}, {G, N}),
    **{t: ({}, set()) for t in ("ID GG GC可出", "Apple ID GG GC可出", "ST GG GC不出", "ID/GG GC不出", "ST/GG GC不出", "Apple ID/GG GC不出", "GG NS不\n出", "GG NS\n不出")},
    **{t: ({}, set()) for t in ("GG/NS不出", "GG/NS,GC不出", "GG、Apple ID不出", "GG、ST不出", "Apple ID、NS不出", "不是 GG GC可出", "不是GG GC可出", "請問GG GC可出", "GG GC可出嗎", "GG、NS不\n出")},
    "GG\nNS不出": ({N: "keep"}, set()),
    **{f"{t}｜NS不出": ({N: "keep"}, set()) for t in ("GG可出 不確定", "GG GC可出 待確認", "可能GG GC可出", "大概 GG可出", "應該 GG GC可出", "據說 GG可出")},
    **{t: ({G: "transfer", C: "transfer"}, set()) for t in ("GG GC可出\n不確定價格", "價格大概\nGG GC可出", "GG GC可出 待確認價格", "GG GC可出 不確定售價", "GG GC可出 待核實資源")},
    "GG可出｜NS可出 不確定": ({G: "transfer"}, set()), "不是綁全出｜GG不出": ({G: "keep"}, set()), "GG可出｜GG不出｜Twitch異常": ({"twitch": "issue"}, {G}), "NS可出/不出": ({}, {N}),
    **{t: ({}, {G}) for t in ("GG無綁/已綁", "GG無綁/有綁", "GG可出/不可出", "GG可出/不能出", "GG可出/無法解", "帳號無綁｜GG可出")},
}


def exactly(**amounts):
    return {(k, "exact", n, n) for k, n in amounts.items()}


RESOURCES = {
    "白蠟 1,000｜愛心 100｜昇華蠟 90｜副卡 2": exactly(candles=1000, hearts=100, ascended=90, passes=2), "愛心眼鏡｜白蠟 30": exactly(candles=30), "１，０００白蠟｜１００愛心｜９０昇華蠟｜２副卡": exactly(candles=1000, hearts=100, ascended=90, passes=2),
    "白蠟 1000｜1000白蠟": exactly(candles=1000), "１．５萬白蠟｜愛心 2千｜昇華蠟 0.0003万": exactly(candles=15000, hearts=2000, ascended=3), "白蠟 1.5萬｜15000白蠟": exactly(candles=15000), "1000白蠟 多禮": exactly(candles=1000),
    "約 1,000 白蠟｜愛心 100+｜20～30紅蠟｜副卡 2": {("candles", "approximate", 1000, 1000), ("hearts", "range", 100, None), ("ascended", "range", 20, 30), ("passes", "exact", 2, 2)}, "白蠟 1.5萬～2萬｜愛心 100以下": {("candles", "range", 15000, 20000), ("hearts", "range", 0, 100)},
    **{t: {("candles", "approximate", 1000, 1000)} for t in ("白蠟 1000左右", "1000白蠟 左右")}, **{t: {("candles", "range", 1000, None)} for t in ("1000白蠟以上", "1000+白蠟｜白蠟1000+")},
    **{f"{t}｜愛心20｜紅蠟30｜副卡1": exactly(hearts=20, ascended=30, passes=1) for t in ("白蠟 100 至 約200", "白蠟 100 -", "白蠟 100 – 200", "白蠟 100 — 200", "100 – 200白蠟")},
    **{t: set() for t in (
        "白蠟 30｜白蠟 50", "白蠟 1000｜2000白蠟", "白蠟 1.5", "白蠟 1,00", "1,00白蠟", "100愛心眼鏡", "1000𖠜｜100ෆ｜90✦", "白蠟 1.5萬｜14000白蠟", "愛心 0.00001萬", "愛心 0.999999999999999999", "白蠟 101萬", "副卡 2千",
        "目前約 100白蠟", "不到 100白蠟", "不是 100白蠟", "白蠟100｜白蠟約200", "白蠟100｜白蠟100+", "白蠟200-100", "白蠟約1萬+", "100白蠟多", "白蠟 10萬～101萬", "沒有 100白蠟｜没有 20愛心｜沒有 30紅蠟｜沒有 1副卡", "",
    )},
}
#: Bounded or approximate: no exact number of them.
INEXACT = ("白蠟 100+", "白蠟 100-200", "白蠟 約1.5萬", "白蠟 1.5萬以上", "白蠟 1.5萬+", "白蠟 1.5萬～2萬", "約 100白蠟", "100白蠟 左右", "100- 200白蠟")


def claims(spark, cases, of):
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", normalised(F.col("t")).alias("n")).select("t", of(F.col("n")).alias("x")).collect()
    return {r.t: r.x for r in rows}


def wrong(got, want):
    return {t: (got[t], w) for t, w in want.items() if got[t] != w}


def test_prices(spark):
    got = claims(spark, PRICES, E.listing_price)
    assert not wrong({t: (x.value, x.kind) if x.reason is None else None for t, x in got.items()}, PRICES)
    assert got["nothing"].reason == "missing_price" and got["售4300 售4100"].reason == "ambiguous_price"


def test_packages(spark):
    got = claims(spark, PACKAGES, T.title_claims)
    want = {t: (w, None) if isinstance(w, int) else (None, w) for t, w in PACKAGES.items()}
    assert not wrong({t: (x.package_count, tuple(x.package_range) if x.package_range else None) for t, x in got.items()}, want)


def test_titles(spark):
    got = claims(spark, TITLES, T.title_claims)
    assert not wrong({t: (x.start_season, x.break_class, x.sale_tier, x.account_style, x.wingless) for t, x in got.items()}, TITLES)


def test_start_seasons(spark):
    got = claims(spark, STARTS, T.title_claims)
    assert not wrong({t: x.start_season for t, x in got.items()}, STARTS)
    assert all(got[t].sale_tier for t in ("姆明毕业礼多礼号", "不是姆明毕业多礼号", "姆明毕业面具少礼号", "姆明畢業進度中禮號", "姆明畢業？多禮號"))
    ended = got["姆明已畢業"]
    assert (ended.break_class, ended.package_count, ended.package_range) == (None, None, None)


def test_headlines(spark):
    rows = spark.createDataFrame([("  ", "N/A", "﻿分頁 1\n\n預言八季禮包號\n綁定資料"), ("狂歡禮包號", None, "其他資料"), (None, None, None)], "a string, b string, c string")
    assert [r.h for r in rows.select(T.headline(F.col("a"), F.col("b"), F.col("c")).alias("h")).collect()] == ["預言八季禮包號", "狂歡禮包號", ""]


def test_bindings(spark):
    got = claims(spark, {**WHOLE, **PLATFORMS}, E.bindings)
    assert not wrong({t: got[t].complete for t in WHOLE}, WHOLE)
    assert not wrong({t: (got[t].by_platform, set(got[t].conflicts)) for t in PLATFORMS}, PLATFORMS)


def test_resources(spark):
    got = claims(spark, [*RESOURCES, *INEXACT], E.resources)
    assert not wrong({t: {tuple(r) for r in got[t]} for t in RESOURCES}, RESOURCES)
    assert not [t for t in INEXACT if any(r.kind == "exact" for r in got[t])]


@pytest.mark.parametrize("of", [E.listing_price, E.bindings, E.resources, T.title_claims])
def test_long_texts_and_nulls(spark, of):
    began = time.time()
    rows = spark.createDataFrame([("GG可出 白蠟 100 售 3000 " * 3000,), (None,)], "t string")
    assert len(rows.select(of(F.col("t")).alias("x")).collect()) == 2
    assert time.time() - began < 60
