"""Layout against plain loops, refusals and merges on the reference cases."""

import random

from pyspark.sql import functions as F

from marlstone.functions import layout as Y
from marlstone.functions.marks import normalised
from marlstone.operators import history, rejections

SEASONS = ("gratitude", "rhythm")


def test_wrapped_names(spark):
    rng = random.Random(1)
    lists = [["".join(rng.choice("abé") for _ in range(rng.randint(1, 25))) for _ in range(rng.randint(0, 12))] for _ in range(60)] + [["a"] * 9, []]

    def brute(names):
        rows, now = [], []
        for name in names:
            if now and (len(now) >= 4 or len("・".join([*now, name])) > 20):
                rows.append("・".join(now))
                now = [name]
            else:
                now.append(name)
        return [*rows, "・".join(now)] if now else rows

    got = spark.createDataFrame([(k, x) for k, x in enumerate(lists)], "k int, n array<string>").select("k", Y.wrapped(F.col("n")).alias("r")).collect()
    assert {r.k: r.r for r in got} == {k: brute(x) for k, x in enumerate(lists)}


def test_progress_rows(spark):
    one = [("A", 0, 2), ("B", 1, 2), ("C", 3, 3), ("D", 0, 4), ("X", 5, 3), ("Y", 1, 0), ("E", 2, 11), ("F", 1, 10)]
    got = spark.createDataFrame([(one,), ([("A", 0, 1)],), ([],)], "s array<struct<name:string,owned:int,total:int>>").select(Y.progress_rows(F.col("s")).alias("r")).collect()
    assert [r.r for r in got] == [["B½｜C畢｜D⁰｜E2/11", "F⅒"], [], []]


def test_boxes_and_pages(spark):
    rng = random.Random(2)
    cases = [[(rng.randint(5, 60), rng.randint(5, 40)) for _ in range(rng.randint(0, 15))] for _ in range(40)]

    def flow(boxes):
        x = y = high = 0
        places = []
        for w, h in boxes:
            w = min(w, 50)
            if x and x + w > 50:
                x, y, high = 0, y + high + 3, 0
            places.append((x, y))
            x, high = x + w + 3, max(high, h)
        return places, y + high if places else 0

    def pages(points, total, limit):
        at, out = 0, []
        while at < total:
            most = min(at + limit, total)
            end = max([p for p in points if at < p <= most], default=most)
            out.append((at, end - at))
            at = end
        return out

    df = spark.createDataFrame([(k, x) for k, x in enumerate(cases)], "k int, b array<struct<w:int,h:int>>").select("k", Y.flowed(F.col("b"), 50, 3).alias("f"))
    df = df.withColumn("p", Y.pages(F.transform("f.places", lambda p: p["y"]), F.col("f.height"), 60))
    for r in df.collect():
        places, height = flow(cases[r.k])
        assert ([tuple(p) for p in r.f.places], r.f.height) == (places, height)
        assert [tuple(p) for p in r.p] == pages([y for _, y in places], height, 60)


def account(k, **more):
    return {"post_key": f"post-{k}", "source_url": "https://www.facebook.com/search/posts/?q=sky", "price": 38000.0, "price_raw": "3.8？萬台", "price_kind": "ask", "intent": "sell", "summary": f"{k} 音韻斷季多禮，3.8？萬台"} | more


KIND = "post_key string, source_url string, price double, price_raw string, price_kind string, intent string, summary string, converted boolean, currency string, server string, market string, exclude_from_model boolean"


def reasons(spark, rows, decisions=None):
    names = [c.split()[0] for c in KIND.split(", ")]
    df = spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], KIND)
    return {r.post_key: r.reason for r in rejections.whole_account_reasons(df, decisions).collect()}


def test_whole_accounts(spark):
    changes = [{"intent": "buy"}, {"price_kind": "sold"}, {"converted": True}, {"price": 0.0}, {"currency": "CNY"}, {"server": "china"}, {"market": "china"}, {"summary": "國服 台幣"}, {"summary": "禮包，附實體徽章 台幣"}, {"summary": "競標起標 台幣"}, {"summary": "刷號 台幣"}, {"exclude_from_model": True}, {"price": None}, {"price": float("inf")}]
    assert all(reasons(spark, [account(k, **c) for k, c in enumerate(changes)]).values())
    assert reasons(spark, [account(1), account(2, price_raw="4000 臺幣", summary="深淵無斷少禮，4000 臺幣")]) == {"post-1": None, "post-2": None}
    assert reasons(spark, [account(1, summary="僅國際服數據，無本體，250台")]) == {"post-1": "data_without_account"}
    d = spark.createDataFrame([("post-1", None, "post-2"), ("post-2", None, "post-3"), ("post-3", "not for sale", None)], "post_key string, exclude string, duplicate_of string")
    assert set(reasons(spark, [account(1), account(2), account(3)], d).values()) == {"not for sale"} and reasons(spark, [account(4)], d) == {"post-4": None}


def test_segments(spark):
    cases = {"#收\n魔法無斷中禮\n預算43000": "buy_not_sell", "#售\n國服魔法無斷中禮號\n價格43000人幣": "foreign_or_china_market", "#代出\n刷篝火猛0魔法無斷中禮\n價格5100台": "modified_or_special_account", "#售\n小王子無斷多禮號\nGG 不出\n8000": None, "魔法號": "missing_sell_intent"}
    got = spark.createDataFrame([(t,) for t in cases], "t string").select("t", normalised(F.col("t")).alias("n")).select("t", rejections.segment_reason(F.col("n"), F.col("n")).alias("r")).collect()
    assert {r.t: r.r for r in got} == cases


def test_the_richest_row_is_the_base(spark):
    rows = [(1, 1, "long", "a", "x"), (1, 2, "", "b", "y"), (1, 3, None, None, None), (1, 0, "older", "c", None), (2, 1, None, None, "z")]
    df = spark.createDataFrame(rows, "k int, at int, text string, a string, b string")
    got = history.snapshot_merge(df, ["k"], "at", "at", F.col("at"), F.lit(True), [], [], base="text", based=("a", "b")).collect()
    assert {r.k: (r.a, r.b) for r in got} == {1: ("a", "x"), 2: (None, "z")}


def test_predictions_or_reasons(spark):
    import numpy as np

    from marlstone.operators import models

    m = models.Model(np.array([9.0, 8.0, 7.0]), np.array([0.5, 0.0, 0.1]), np.array([-0.2, 0.0, -0.3]), 1)
    rows = spark.createDataFrame([(0, "few", "none"), (1, "hundred", "large"), (2, "few", "none"), (7, "few", "none"), (None, "medium", None)], "season int, tier string, break_class string")
    got = {r.season: r for r in models.predict_or_say(rows, m, {0: 0.1, 1: 0.0, 2: float("nan")}, (8.5, 0.2)).collect()}
    assert (got[0].status, got[0].midpoint, got[0].low, got[0].high, got[0].method) == ("unvalidated", 8100.0, 7330.0, 8960.0, "season")
    assert got[1].midpoint == got[1].low == got[1].high and (got[None].method, got[None].midpoint) == ("pooled", 8100.0)
    assert {s: (got[s].status, got[s].reason, got[s].midpoint) for s in (2, 7)} == {s: ("unavailable", "invalid_model_season", None) for s in (2, 7)}
    wrong = models.Model(m.season, -m.tiers, m.breaks, 1)
    assert {r.reason for r in models.predict_or_say(rows, wrong, {0: 0.1}, None).collect()} == {"model_not_ready"}


def test_json_documents_and_text_lines(spark, tmp_path):
    from marlstone.sources import files

    (tmp_path / "a.json").write_text('{\n  "items": [\n    {"id": 1, "n": "x"},\n    {"id": 2}\n  ], "other": 3\n}')
    (tmp_path / "b.json").write_text('[\n {"id": 5, "n": "y"}\n]')
    assert sorted(tuple(r) for r in files.read_json_document(spark, str(tmp_path / "a.json"), "id int, n string", "items").collect()) == [(1, "x"), (2, None)]
    assert [tuple(r) for r in files.read_json_document(spark, str(tmp_path / "b.json"), "id int, n string").collect()] == [(5, "y")]
    lines = spark.createDataFrame([(2, "b"), (1, "a")], "k int, t string")
    assert sorted(r.value for r in files.text_lines(lines, [F.col("k")], "t").collect()) == ["b", "\ufeffa"]
