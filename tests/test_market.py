"""Lookups, alignment and small formats against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.functions import evidence
from marlstone.functions import text as T
from marlstone.operators import alignment, hierarchy, percentage
from marlstone.sources import gifts

BY_CELL = "season int, tier string, break_class string, n double, sy double"


def test_lookup_is_the_constrained_minimum_of_the_rows():
    rng = np.random.default_rng(4)
    seasons = 4
    s, t, b = rng.integers(0, seasons, 300), rng.integers(0, 4, 300), rng.integers(0, 4, 300)
    y = 5 - 0.2 * s + 0.3 * t - 0.1 * b + rng.normal(0, 0.3, 300)
    x, p = hierarchy.design(s, t, b, seasons), hierarchy.pulls(seasons, 1.0, 3.0, 2.0)
    loss = lambda w: ((x @ w - y) ** 2).sum() + ((p @ w) ** 2).sum()
    w = hierarchy.non_negative(x.T @ x + p.T @ p, x.T @ y)
    assert (w[1:] >= 0).all()
    slope = x.T @ (x @ w - y) + p.T @ (p @ w)
    assert np.abs(slope[w > 0]).max() < 1e-6 and slope[1:].min() > -1e-6  # the conditions of the minimum
    for _ in range(200):
        other = w + rng.normal(0, 0.02, len(w))
        other[1:] = np.maximum(other[1:], 0)
        assert loss(w) <= loss(other) + 1e-9


def test_lookup_from_cells_equals_that_from_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(int(rng.integers(0, 3)), hierarchy.TIERS[rng.integers(0, 4)], hierarchy.BREAKS[rng.integers(0, 4)], float(rng.normal(3, 1))) for _ in range(200)]
    df = spark.createDataFrame(rows, "season int, tier string, break_class string, y double")
    model = hierarchy.fit_lookup(df.groupBy("season", "tier", "break_class").agg(F.count("*").cast("double").alias("n"), F.sum("y").alias("sy")))
    s, t, b = (np.array(v) for v in zip(*((r[0], hierarchy.TIERS.index(r[1]), hierarchy.BREAKS.index(r[2])) for r in rows)))
    x, p = hierarchy.design(s, t, b, 3), hierarchy.pulls(3, 1.0, 10.0, 10.0)
    assert np.allclose(model.steps, hierarchy.non_negative(x.T @ x + p.T @ p, x.T @ np.array([r[3] for r in rows])), atol=1e-8)
    grid = model.log_price
    assert (np.diff(grid[:, 0, 0]) <= 1e-9).all() and (np.diff(grid, axis=1) >= -1e-9).all() and (np.diff(grid, axis=2) <= 1e-9).all()
    got = {r[:3]: r.predicted for r in hierarchy.lookup_price(df.select("season", "tier", "break_class").distinct(), model).collect()}
    assert all(np.isclose(v, np.exp(grid[k[0], hierarchy.TIERS.index(k[1]), hierarchy.BREAKS.index(k[2])])) for k, v in got.items())
    with pytest.raises(ValueError):
        hierarchy.fit_lookup(spark.createDataFrame([], BY_CELL))


def test_pulls_are_the_stated_rows():
    seasons, alphas = 3, (2.0, 5.0, 7.0)
    rng = np.random.default_rng(1)
    w = rng.normal(0, 1, 1 + seasons - 1 + 6 + 6 * seasons)
    steps, market, own = w[1:seasons], w[seasons : seasons + 6].reshape(2, 3), w[seasons + 6 :].reshape(2, seasons, 3)
    want = alphas[0] * (steps**2).sum() + (market**2).sum() + alphas[1] * ((own - market[:, None, :]) ** 2).sum() + alphas[2] * ((own[:, 1:] - own[:, :-1]) ** 2).sum()
    assert np.isclose(((hierarchy.pulls(seasons, *alphas) @ w) ** 2).sum(), want)


def test_unknown_classes_and_empty_tables(spark):
    from marlstone.operators import models

    kind = "l_orderkey long, l_shipdate date, l_extendedprice double, l_quantity double, l_discount double"
    import datetime as d

    rows = [(k, d.date(2000 + k % 3, 1 + k % 12, 1), 100.0 + k, None if k % 4 == 0 else float(k), None if k % 5 == 0 else 0.01 * (k % 9)) for k in range(60)]
    rows += [(90, d.date(9999, 12, 1), 5.0, 1.0, 0.0), (91, None, 5.0, 1.0, 0.0), (92, d.date(2000, 1, 1), None, 1.0, 0.0)]
    items = spark.createDataFrame(rows, kind)
    priced = models.priced_rows(items)
    assert priced.agg(F.max("season")).first()[0] == 12 and priced.count() == 61
    assert models.predict(priced, models.fit_cells(models.cells(priced))).filter("predicted IS NULL").count() == 0
    priced, cells = hierarchy.lookup_cells(items)
    assert hierarchy.lookup_price(priced, hierarchy.fit_lookup(cells)).filter("predicted IS NULL").count() == 0
    none = models.priced_rows(items.limit(0))
    assert models.predict(none, models.fit_cells(models.cells(none))).count() == 0


def test_robust_lookup_withstands_outliers(spark):
    rng = np.random.default_rng(6)
    rows = [(k % 2, "few", "none", 3.0 + float(rng.normal(0, 0.1)) + (8.0 if k % 10 == 0 else 0.0)) for k in range(300)]
    df = spark.createDataFrame(rows, "season int, tier string, break_class string, y double")
    plain = hierarchy.fit_lookup(df.groupBy("season", "tier", "break_class").agg(F.count("*").cast("double").alias("n"), F.sum("y").alias("sy")))
    robust = hierarchy.fit_robust(df, 4.0, rounds=3)
    assert abs(robust.log_price[0, 0, 0] - 3) < 0.35 * abs(plain.log_price[0, 0, 0] - 3)


def brute_anchored(pairs, n_i, n_j):
    ordered = sorted(pairs)
    if any(b[1] <= a[1] for a, b in zip(ordered, ordered[1:])):
        return set()
    ends = [(0, 0), *ordered, (n_i + 1, n_j + 1)]
    out = set()
    for k in range(1, len(ends)):
        (a, b), (c, d) = ends[k - 1], ends[k]
        most = 8 if k in (1, len(ends) - 1) else 16
        if 0 < c - a - 1 == d - b - 1 <= most:
            out |= {(a + m, b + m) for m in range(1, c - a)}
    return out


def test_places_between_anchors(spark):
    rng = np.random.default_rng(8)
    cases = {g: (sorted(zip(*(sorted(rng.choice(np.arange(1, 60), 6, False).tolist()) for _ in "ij"))), 60 + int(rng.integers(0, 3)), 60) for g in range(12)}
    cases[20] = ([(3, 9), (5, 4)], 20, 20)
    cases[21] = ([], 5, 5)
    cases[22] = ([(10, 10), (27, 27), (45, 45)], 50, 50)
    anchors = spark.createDataFrame([(g, int(i), int(j)) for g, (p, _, _) in cases.items() for i, j in p], "g int, i long, j long")
    sizes = spark.createDataFrame([(g, a, b) for g, (_, a, b) in cases.items()], "g int, n_i long, n_j long")
    got = {(r.g, r.i, r.j) for r in alignment.anchored(anchors, sizes, "g").collect()}
    assert got == {(g, i, j) for g, (p, a, b) in cases.items() for i, j in brute_anchored(p, a, b)}


def test_lua_records_and_labels(spark):
    lua = 'return { ["x"] = { name = "A \\\\"b\\\\"", guid=12, zh = \'c\' }, { name="d", name = "e" }, {} }'.replace("\\\\", "\\")
    df = spark.createDataFrame([(lua,), ("none",), (None,)], "t string")
    got = [r.x for r in df.select(T.lua_records(F.col("t")).alias("x")).collect()]
    assert got == [[{"name": 'A "b"', "guid": "12", "zh": "c"}, {"name": "e"}], [], None]
    labels = spark.range(12).select(T.fraction(F.col("id"), 6).alias("f"), T.fraction(F.col("id"), 7).alias("s")).collect()
    assert [r.f for r in labels[:7]] == ["0", "⅙", "⅓", "½", "⅔", "⅚", "1"] and labels[9].s == "1 2/7" and labels[3].s == "3/7"


def test_percentages_are_the_constrained_minimum_and_are_explained(spark):
    rng = np.random.default_rng(11)
    seasons, rows = 5, []
    for _ in range(400):
        s, t, b, w = int(rng.integers(-1, seasons)), int(rng.integers(-1, 4)), int(rng.integers(-1, 4)), float(rng.integers(0, 50))
        y = 11 - 0.4 * max(s, 0) + 0.2 * t - 0.15 * b + 0.05 * np.log1p(w) + rng.normal(0, 0.4)
        rows.append((s if s >= 0 else None, hierarchy.TIERS[t] if t >= 0 else None, hierarchy.BREAKS[b] if b >= 0 else None, float(y), w, int(rng.integers(0, 400))))
    df = spark.createDataFrame(rows, "season int, tier string, break_class string, y double, wax double, packages int")
    anchors = {0: float(np.exp(10.6)), 3: float(np.exp(9.0))}
    m = percentage.fit(percentage.sums(df, ("wax",)), seasons, anchors, ("wax",), within=0.1)

    def loss(base, breaks, packages, wax):
        total = 0.0
        for s, t, b, y, w, _ in rows:
            x = base[seasons if s is None else s] + wax * np.log1p(w)
            x += breaks[: hierarchy.BREAKS.index(b)].sum() if b else 0
            x += ((hierarchy.TIERS.index(t) >= np.arange(1, 4)) - np.array([1, 0.5, 0])) @ packages if t else 0
            total += (x - y) ** 2
        return total + 10 * ((breaks**2).sum() + (packages**2).sum() + wax**2) + 0.5 * (np.diff(base[:-1]) ** 2).sum()

    wax = m.resources["wax"]
    assert (np.diff(m.base[:-1]) <= 1e-9).all() and (m.breaks <= 0).all() and (m.packages >= 0).all() and wax >= 0
    assert all(abs(np.exp(m.base[s]) / p - 1) <= 0.1 + 1e-9 for s, p in anchors.items())
    here = loss(m.base, m.breaks, m.packages, wax)
    for _ in range(150):
        base = m.base + rng.normal(0, 0.02, seasons + 1)
        base[:-1] = percentage.falling(base[:-1])
        if all(abs(np.exp(base[s]) / p - 1) <= 0.1 for s, p in anchors.items()):
            assert here <= loss(base, np.minimum(m.breaks + rng.normal(0, 0.02, 3), 0), np.maximum(m.packages + rng.normal(0, 0.02, 3), 0), max(0, wax + rng.normal(0, 0.01))) + 1e-7

    got = percentage.explain(df, m, "packages").collect()
    scale = np.r_[m.elasticity(), 1.0]
    for r in got:
        s = seasons if r.season is None else r.season
        want = m.base[s] + float(m.count_log(np.array(float(r.packages)))) * scale[s] + wax * np.log1p(r.wax) + (m.breaks[: hierarchy.BREAKS.index(r.break_class)].sum() if r.break_class else 0)
        assert np.isclose(np.log(r.predicted), want) and np.isclose(r.predicted, r.base_price * r.break_factor * r.package_factor * r.resource_factor)
    counts = np.arange(0, 600)
    curve = m.count_log(counts)
    assert (np.diff(curve) >= -1e-12).all() and np.allclose(curve[[30, 75, 95, 150]], m.controls())
    prices = m.base[:-1, None] + scale[:-1, None] * curve[None, :351]
    assert (np.diff(prices, axis=0) <= 1e-9).all()  # the order of seasons holds at every count
    with pytest.raises(ValueError):
        percentage.fit(percentage.sums(df.limit(0), ()), seasons, {})


def test_adjusted_bases_and_bindings_are_the_constrained_minimum(spark):
    rng = np.random.default_rng(12)
    seasons, rows = 4, []
    for k in range(300):
        s, t, b, w = int(rng.integers(0, seasons)), int(rng.integers(0, 4)), int(rng.integers(0, 4)), float(rng.integers(0, 50))
        tie = {"google": str(rng.choice(["transfer", "keep", "unknown"])), "rare": "issue" if k < 3 else None}
        y = 10 - 0.5 * s + 0.2 * t - 0.1 * b + 0.03 * np.log1p(w) + (0.3 if tie["google"] == "transfer" else 0) + rng.normal(0, 0.3)
        rows.append((s, hierarchy.TIERS[t], hierarchy.BREAKS[b], float(y), w, k % (3 if s == 2 else 40), tie))
    df = spark.createDataFrame(rows, "season int, tier string, break_class string, y double, wax double, seller int, bindings map<string,string>")
    kinds, movable = percentage.supported_bindings(df), percentage.supported_seasons(df, "seller")
    assert kinds == (("google", "keep"), ("google", "transfer")) and movable == {0, 1, 3}
    cells = percentage.sums(df, ("wax",), kinds)
    first = percentage.fit(cells, seasons, {0: float(np.exp(9.0))}, ("wax",), kinds=kinds)
    m = percentage.fit_adjusted(cells, seasons, {0: float(np.exp(9.0))}, movable, ("wax",), kinds)
    assert np.isclose(first.base[0], 9.0) and m.base[0] > 9.3 and np.isclose(m.base[2], first.base[2], atol=1e-8) and (np.diff(m.base[:-1]) <= 1e-9).all()

    def loss(base, breaks, packages, wax, tied):
        total = 0.0
        for s, t, b, y, w, _, tie in rows:
            x = base[s] + wax * np.log1p(w) + breaks[: hierarchy.BREAKS.index(b)].sum() + ((hierarchy.TIERS.index(t) >= np.arange(1, 4)) - np.array([1, 0.5, 0])) @ packages
            total += (x + sum(v for (k, status), v in zip(kinds, tied) if tie[k] == status) - y) ** 2
        pull = sum(2 * (base[s] - first.base[s]) ** 2 for s in movable)
        return total + 10 * ((breaks**2).sum() + (packages**2).sum() + wax**2 + (tied**2).sum()) + 0.5 * (np.diff(base[:-1]) ** 2).sum() + pull

    tied, wax = np.array([m.bindings[k] for k in kinds]), m.resources["wax"]
    assert tied[1] > tied[0]
    here = loss(m.base, m.breaks, m.packages, wax, tied)
    for _ in range(150):
        base = m.base + np.where(np.arange(5) == 2, 0, rng.normal(0, 0.02, 5))
        if (np.diff(base[:-1]) <= 0).all():
            assert here <= loss(base, np.minimum(m.breaks + rng.normal(0, 0.02, 3), 0), np.maximum(m.packages + rng.normal(0, 0.02, 3), 0), max(0, wax + rng.normal(0, 0.01)), tied + rng.normal(0, 0.02, 2)) + 1e-7
    for r in percentage.explain(df, m).collect():
        want = m.bindings.get(("google", r.bindings["google"]), 0.0)
        assert np.isclose(np.log(r.binding_factor), want) and np.isclose(r.predicted, r.base_price * r.break_factor * r.package_factor * r.resource_factor * r.binding_factor)


def test_cubic_keeps_to_its_points():
    x, y = np.array([0.0, 1, 3, 4, 9]), np.array([0.0, 2, 2, 3, 1])
    assert np.allclose(percentage.slopes(x, y), [3.3333333, 0, 0, 0, -1.0], atol=2.5) and percentage.slopes(x, y)[2] == 0
    assert percentage.falling(np.array([1.0, 3, 2, 5, 0])).tolist() == [2.75, 2.75, 2.75, 2.75, 0]


def test_gift_pages(spark):
    def html(icons, name="雙件套", count=1):
        pics = "".join(f'<img alt="{i}" src="x">' for i in icons)
        return f'<div id="gc">{count}</div><div id="gl"><div class="g-item"><div class="nm">{name}</div><div class="pr">$20<span>¥148 / NT$690</span><span>₫599,000</span><br></div><div class="g-extras">蠟燭 ×75</div><div class="g-unlocks">{pics}</div></div></div>'

    pages = [("both", html("AB")), ("one", html("A", "單件")), ("label", html("C", "超值禮包")), ("single", html("C", "單件")), ("unknown", html("Z")), ("none", html("")), ("wrong", html("A", count=2)), ("empty", '<div id="gc">0</div><div id="gl"></div>'), ("null", None)]
    rows = gifts.gift_packages(spark.createDataFrame(pages, "page string, html string"))
    assert {r.page for r in rows.filter("reason IS NOT NULL").collect()} == {"wrong", "empty", "null"}
    shown = rows.filter("page = 'both'").select(gifts.displayed_prices(F.col("price_text")).alias("p"), "extras").first()
    assert [(p.currency, p.amount) for p in shown.p] == [(None, 20.0), (None, 148.0), ("TWD", 690.0), ("VND", 599000.0)] and shown.extras == "蠟燭 ×75"
    icons = spark.createDataFrame([("A", "a"), ("B", "b"), ("C", "c")], "icon string, guid string")
    catalog = spark.createDataFrame([("a", True, "pair"), ("b", True, "pair"), ("c", True, "solo")], "guid string, paid boolean, package_key string")
    got = {r.page: (r.status, r.package_key, r.name_item) for r in gifts.package_status(rows, icons, catalog).collect()}
    assert got == {"both": ("exact-members", "pair", None), "one": ("review-package-members", None, None), "label": ("exact-members", "solo", None), "single": ("exact-members", "solo", "c"), "unknown": ("unknown-member", None, None), "none": ("unknown-member", None, None)}


def test_graduation_lists(spark):
    seasons = (("dreams", "夢想|梦想"), ("assembly", "集結|集结"), ("flight", "風行|风行"), ("abyss", "潛海"))
    cases = {
        "畢業季節：夢想、集結 3/4、未畢業風行 禮包：潛海": [("dreams", "full"), ("assembly", "partial")], "毕业季节: 半梦想 集结半毕业 风行季卡": [("dreams", "partial"), ("assembly", "partial")],
        "畢業季節：夢想 0/4 集結 5/4 風行 4/4": [("flight", "full")], "夢想": [], "": [],
    }
    got = spark.createDataFrame([(t,) for t in cases], "t string").select("t", evidence.graduations(F.col("t"), seasons).alias("g")).collect()
    assert {r.t: [tuple(x) for x in r.g] for r in got} == cases
