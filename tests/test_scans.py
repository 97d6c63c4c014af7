"""Names in text, masks, pages and records against brute force and worked cases."""

import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import masks, spans
from marlstone.sources import pages, records


def brute_spans(texts, names, groups):
    """The rule said plainly: every name tried at every place of every piece."""
    form = lambda s: re.sub(spans.DROPPED, "", unicodedata.normalize("NFKC", s).lower())
    terms = {}
    for name, item in names:
        if len(form(name)) >= 2:
            terms.setdefault(form(name), set()).add(item)
    out = set()
    for i, text in texts:
        pieces = [p.strip() for p in re.split(spans.SEPARATORS, text or "")]
        for place, piece in enumerate(form(p) for p in pieces if p):
            found = []
            if piece in terms:
                found = [(-1, piece)]
            else:
                every = sorted((m.start(), -len(t), t) for t in terms if len(t) >= 3 for m in re.finditer(f"(?={re.escape(t)})", piece))
                end = 0
                for start, less, t in every:
                    if start >= end:
                        found.append((start, t))
                        end = start - less
            for start, t in found:
                absent = start >= 0 and (re.search(spans.ABSENT_BEFORE, piece[max(0, start - 5) : start]) or re.search(spans.ABSENT_AFTER, piece[start + len(t) :][:5]))
                route = "excluded" if absent else "matched" if len(terms[t]) == 1 else "group" if t in groups else "ambiguous"
                out.add((i, place, start, t, route))
            if piece and not found:
                out.add((i, place, None, None, "unmatched"))
    return out


@pytest.mark.parametrize("block", [1000, 7])
def test_names_in_texts(spark, block):
    rng = random.Random(5)
    names = [("".join(rng.choice("abc") for _ in range(rng.randint(1, 6))), rng.randrange(40)) for _ in range(50)] + [("Cat Set", 1), ("cat-set", 2), ("ＣＡＴ ear", 3), ("貓貓套裝", 4), ("貓貓套裝", 5), ("護士帽", 6)]
    texts = [(k, rng.choice(["｜", ", ", "\n"]).join("".join(rng.choice(["a", "b", "c", "ab", "沒有", "無", " ", "已售"]) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(0, 5)))) for k in range(150)]
    texts += [(900, "CAT  SET｜沒有貓貓套裝｜貓貓套裝 護士帽"), (901, None), (902, ""), (903, "護士帽已售、我有護士帽嗎")]
    groups = ("貓貓套裝",)
    known = spans.dictionary(spark.createDataFrame(names, "name string, item int"), "name", "item")
    got = spans.spans(spark.createDataFrame(texts, "id int, text string"), "id", "text", known, groups, block=block)
    assert {(r.id, r.place, r.start, r.term, r.route) for r in got.collect()} == brute_spans(texts, names, groups)


def test_texts_are_read_once_for_any_number_of_names(spark):
    names = spark.createDataFrame([(f"name {k}", k) for k in range(100)], "name string, item int")
    text = spark.createDataFrame([(1, "xname12y")], "id int, text string")
    got = spans.spans(text, "id", "text", spans.dictionary(names, "name", "item"), block=7)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert [(r.start, r.term, r["items"]) for r in got.collect()] == [(1, "name12", [12])]


def test_names_without_their_items(spark):
    rows = [("many things", k) for k in range(3000)] + [("one thing", 5), ("One-Thing", 5), ("x", 6), ("generic", 7), ("none", None)]
    names = spark.createDataFrame(rows, "name string, item int")
    text = spark.createDataFrame([(1, "many things, one thing!, amanythings, generic"), (2, None), (3, " , ")], "id int, text string")
    known = [f(names, "name", "item", ("generic",)) for f in (spans.single, spans.dictionary)]
    assert {tuple(r) for r in known[0].collect()} == {("manythings", None), ("onething", 5)}
    got = [spans.spans(text, "id", "text", k, ("manythings",)) for k in known]
    assert "items" not in got[0].columns
    told = [{(r.place, r.start, r.term, r.item, r.route) for r in g.collect()} for g in got]
    assert told[0] == told[1] == {(0, -1, "manythings", None, "group"), (1, -1, "onething", 5, "matched"), (2, 1, "manythings", None, "group"), (3, None, None, None, "unmatched")}


def test_form_of_a_text_is_that_of_its_pieces(spark):
    names = [("cat", 1), ("ΑΣ", 2), ("é", 3), ("a,b", 4), ("貓貓貓", 5), ("verylongnameofathing", 6), ("verylong", 7), ("verylongnameofathings", 8)]
    texts = ["ΑΣ\nβ|ΑΣ", "e\u0301x|e|\u0301e", "a︐b", "ｃａｔ\xa0ｓ，x c.a-t", "q貓貓貓貓|~~|貓", "verylongnameofathing verylongnamesverylongnameofathings", "  | \t|-cat-"]
    known = spans.dictionary(spark.createDataFrame(names, "name string, item int"), "name", "item")
    got = spans.spans(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "id", "text", known, block=1)
    assert {(r.id, r.place, r.start, r.term, r.route) for r in got.collect() if r.id < 6} == brute_spans(list(enumerate(texts[:6])), names, ())
    assert [(r.place, r.start, r.term) for r in got.filter("id = 6").collect()] == [(1, -1, "cat")]  # the tab counts as a piece that has nothing left


def test_one_row_for_each_item(spark):
    names = spark.createDataFrame([("藍色帽子", 7), ("護士帽", 7), ("白鳥", 8), ("白鳥", 9)], "name string, item int")
    text = spark.createDataFrame([(1, "我的護士帽｜藍色帽子｜護士帽很好｜白鳥｜沒有護士帽")], "id int, text string")
    got = spans.resolved(spans.spans(text, "id", "text", spans.dictionary(names, "name", "item"))).collect()
    assert {(r.route, r.thing, r.term) for r in got} == {("matched", "7", "藍色帽子"), ("ambiguous", "白鳥", "白鳥"), ("excluded", "護士帽", "護士帽")}


def square(size, left, top, width, height):
    m = np.zeros((size, size), bool)
    m[top : top + height, left : left + width] = True
    return m


def brute_overlap(a, b, shift):
    best = 0.0
    for dy in range(-shift, shift + 1):
        for dx in range(-shift, shift + 1):
            moved = np.zeros_like(b)
            for y, x in zip(*np.nonzero(b)):
                if 0 <= y + dy < len(b) and 0 <= x + dx < len(b):
                    moved[y + dy, x + dx] = True
            if (a | moved).any():
                best = max(best, (a & moved).sum() / (a | moved).sum())
    return best


def test_overlaps_equal_brute_force(spark):
    first, near = square(8, 2, 2, 3, 4), square(8, 3, 1, 3, 4)
    pack = lambda *m: masks.packed(np.array(m), len(m[0]))
    assert masks.overlaps(pack(first), pack(first, near), 2).tolist() == [[1.0, 1.0]]
    rng = np.random.default_rng(7)
    for size, shift in ((5, 2), (11, 4), (64, 1)):
        a, b = rng.random((4, size, size)) < 0.3, rng.random((6, size, size)) < 0.3
        b[5] = False
        assert np.allclose(masks.overlaps(masks.packed(a, size), masks.packed(b, size), shift), [[brute_overlap(x, y, shift) for y in b] for x in a])


def test_best_masks(spark, monkeypatch):
    monkeypatch.setattr(masks, "SHARD", 9)
    monkeypatch.setattr(masks, "BLOCK", 3)
    rng = np.random.default_rng(8)
    x = rng.random((40, 36)) < 0.4
    x[20] = x[0]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(50, None), (51, [True]), (52, [None] * 36)]
    got = masks.best_overlaps(spark.createDataFrame(rows, "id long, m array<boolean>"), F.col("id") % 10 == 0, "id", "m", 6, 2, 3).collect()
    for q in range(0, 40, 10):
        want = sorted((-round(brute_overlap(x[q].reshape(6, 6), x[k].reshape(6, 6), 2), 9), k) for k in range(40) if k != q)[:3]
        assert [(-r.score, r.ref) for r in sorted(got, key=lambda r: r["rank"]) if r["query"] == q] == want
    told = {r.query: (r.ref, r.status) for r in masks.classified(spark.createDataFrame(got)).collect()}
    assert told[0] == (20, "accepted") and told[10][1] == "review"
    three = spark.createDataFrame([(1, 5, 0.97, 1), (1, 6, 0.91, 2), (2, 5, 0.96, 1), (2, 6, 0.94, 2), (3, 5, 0.82, 1), (3, 6, 0.5, 2)], "query long, ref long, score double, rank int")
    assert {r.query: r.status for r in masks.classified(three).collect()} == {1: "accepted", 2: "review", 3: "review"}


def test_masks_beyond_the_first_ones(spark, monkeypatch):
    monkeypatch.setattr(masks, "FIRST", 5)
    monkeypatch.setattr(masks, "ROWS", 3)
    monkeypatch.setattr(masks, "COLUMNS", 7)
    rng = np.random.default_rng(9)
    for size, shift in ((8, 4), (11, 2)):
        x = rng.random((70, size, size)) < rng.choice([0.0, 0.1, 0.4, 0.6], (70, 1, 1))
        x[20:40] = x[0]
        names, words = rng.permutation(70), masks.packed(x, size)
        score = np.round(masks.overlaps(words, words, shift), 9)
        got = masks.nearest(words, names, words, names, shift, 3)
        for q in range(70):
            want = sorted((-score[q, k], names[k]) for k in range(70) if k != q)[:3]
            assert [(-round(s, 9), n) for n, s in zip(got[0][q], got[1][q], strict=True)] == want


def test_masks_of_one_key_are_one_reference(spark):
    m = {k: square(6, k, k, 3, 3).ravel().tolist() for k in (0, 1)} | {2: square(6, 0, 0, 6, 1).ravel().tolist()}
    rows = spark.createDataFrame([(0, m[0]), (1, m[0]), (1, m[1]), (1, m[0]), (2, m[2]), (0, m[2])], "id long, m array<boolean>")
    got = masks.best_overlaps(rows, F.col("id") == 0, "id", "m", 6, 1).collect()
    assert {(r["query"], r["ref"], r["score"], r["rank"]) for r in got} == {(0, 1, 1.0, 1), (0, 2, 1.0, 2)}


def test_few_shifts_of_masks_are_compared(monkeypatch):
    compared, shared = [], masks.shared
    monkeypatch.setattr(masks, "shared", lambda a, b: compared.append(len(a) * len(b)) or shared(a, b))
    words = masks.packed(np.random.default_rng(10).random((4000, 64)) < 0.5, 8)
    masks.nearest(words[:100], np.arange(100), words, np.arange(4000), 4, 2)
    assert sum(compared) < 40 * 100 * 4000  # of 81 shifts, those of the first 256 masks included


def test_pages_as_rows(spark):
    html = """<!-- <a class="tc-item" href="?id=9"></a> --><ul id=gl><li class="tc-item x" data-s="5"><b class=nm>A &amp; <i>b</i></b><img alt="p"><img alt='q'/><div class="pr">1<div>2</div></div></li>
      <li class="tc-item"><b class="nm">no close<li class="tc-item"><span class="nm">inner</span></li></li><li class="other"><b class="nm">z</b></li></ul><p id="n"> 3 </p><div class="tc-item">outside</div>"""
    docs = spark.createDataFrame([(1, html), (2, None), (3, "<p id=n>0")], "page int, html string")
    got = pages.html_rows(docs, "page", "html", "#gl li.tc-item", {"name": ".nm", "size": "@data-s", "icons": "img@alt", "price": ".pr div", "deep": "li .nm"}, {"n": "#n"}).collect()
    assert [(r.page, r.place, r.of, r["name"], r["size"], r.icons, r.price, r.n) for r in sorted(got, key=lambda r: (r.page, r.place or 0))] == [
        (1, 1, 3, ["A & b"], ["5"], ["p", "q"], ["2"], [" 3 "]),
        (1, 2, 3, ["no closeinner", "inner"], [""], [], [], [" 3 "]),
        (1, 3, 3, ["inner"], [""], [], [], [" 3 "]),
        (2, None, 0, [], [], [], [], []),
        (3, None, 0, [], [], [], [], ["0"]),
    ]
    with pytest.raises(ValueError):
        pages.compiled("a > b")
    urls = spark.createDataFrame([("/lots/offer?id=12&x=3",), ("https://a/b?x=1&id=a%20b#id=7",), ("/lots?idx=4",), (None,)], "u string")
    assert [r[0] for r in urls.select(pages.query_value(F.col("u"), "id")).collect()] == ["12", "a b", None, None]


def test_nested_records(spark):
    text = """return {
    cape = { name = "Cape {of} \\"night\\"", zh = 'x}', sizes = { small = "s", large = { note = "}" } }, n = 4 },
    open = { name = "never
    hat = { name = "old" },
}
hat = { name = "new", -- it's
  guid = 'g' }
end = { name = "lost" """
    want = {"cape": {"name": 'Cape {of} "night"', "zh": "x}", "small": "s", "note": "}"}}
    got = records.records(text)
    assert got["cape"] == want["cape"] and "end" not in got
    rows = records.named_records(spark.createDataFrame([(1, 'a = { x = "1" }\\nb = {{}}\\n a = { y = "2" }'.replace("\\n", "\n")), (2, None), (3, "")], "k int, t string"), "k", "t").collect()
    assert {(r.k, r.record): r.fields for r in rows} == {(1, "a"): {"y": "2"}, (1, "b"): {}}
