"""The core queries that SQL can't express, against plain Python over sf0.001."""

import hashlib
import math
import re
import unicodedata

import numpy as np
import pytest

from marlstone.operators import hierarchy, models
from marlstone.plans import registry

SF = "/root/testdata/sf0.001"


def rows(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet").collect()


def test_normalize_text(spark):
    want = {r.doc_id: None if r.text is None else hashlib.sha256(re.sub(r"\s+", "", unicodedata.normalize("NFKC", r.text).lower()).encode()).hexdigest() for r in rows(spark, "documents")}
    assert {r.doc_id: r.normalized_sha256 for r in registry.queries()["normalize_text"](spark, SF).collect()} == want


def test_sequence_align(spark):
    turns = {}
    for r in sorted(rows(spark, "conversations"), key=lambda r: (r.conv_id, r.turn)):
        turns.setdefault(r.conv_id, ([], []))[r.role != "user"].append(set(re.split("[^a-z]+", r.text.lower())))
    want = {}
    for conv, (a, b) in turns.items():
        best = {}

        def score(i, j):
            if (i, j) not in best:
                if not i or not j:
                    best[i, j] = -0.65 * (i + j)
                else:
                    alike = len(a[i - 1] & b[j - 1]) / (len(a[i - 1] | b[j - 1]) or 1)
                    best[i, j] = max(score(i - 1, j) - 0.65, score(i, j - 1) - 0.65, score(i - 1, j - 1) + 3 * alike + 0.2)
            return best[i, j]

        want[conv] = round(score(len(a), len(b)), 6)
    assert {r.conv_id: r.score for r in registry.queries()["sequence_align"](spark, SF).collect()} == want


def priced(spark):
    out = []
    items = [r for r in rows(spark, "lineitem") if r.l_extendedprice > 0]
    first = min(r.l_shipdate.year * 4 + (r.l_shipdate.month - 1) // 3 for r in items)
    for r in items:
        q, d = float(r.l_quantity) * 2, float(r.l_discount)
        t = 3 if q >= 90 else 2 if q >= 60 else 1 if q >= 30 else 0
        b = 3 if d >= 0.08 else 2 if d >= 0.05 else 1 if d >= 0.02 else 0
        out.append((r.l_orderkey, r.l_linenumber, r.l_shipdate.year * 4 + (r.l_shipdate.month - 1) // 3 - first, t, b, math.log(r.l_extendedprice), r.l_suppkey))
    return out


def test_price_model(spark):
    """The prediction is that of a model whose steps' slopes on the rows themselves are what the ridge holds."""
    own = priced(spark)
    got = registry.queries()["price_model_predict"](spark, SF).collect()
    key = lambda o, n, s, t, b: (o, n, s, models.TIERS[t], models.BREAKS[b])
    assert sorted((r.l_orderkey, r.l_linenumber, r.season, r.tier, r.break_class) for r in got) == sorted(key(*r[:5]) for r in own)
    log = {(r.season, models.TIERS.index(r.tier), models.BREAKS.index(r.break_class)): math.log(r.predicted) for r in got}
    assert np.allclose(sorted(math.log(r.predicted) + r.residual for r in got), sorted(r[5] for r in own), atol=1e-4)
    for (s, t, b), v in log.items():
        assert (s, t + 1, b) not in log or log[s, t + 1, b] >= v - 1e-6
        assert (s, t, b + 1) not in log or log[s, t, b + 1] <= v + 1e-6
    s, t, b, y = (np.array([r[k] for r in own]) for k in (2, 3, 4, 5))
    fitted = np.array([log[k] for k in zip(s, t, b)])
    for over in (*(t > k for k in range(3)), *(b > k for k in range(3))):
        # A step's slope is its ridge (weight 1) times its size, unless it is held at zero by its sign.
        pull, rises = (y - fitted)[over].sum(), any(np.array_equal(over, t > k) for k in range(3))
        assert abs(pull) < 3 or (pull < 0 if rises else pull > 0)
    assert np.mean((y - fitted) ** 2) < np.mean((y - y.mean()) ** 2)


def test_monotone_projection(spark):
    cells = {}
    for _, _, s, t, b, y, _ in priced(spark):
        cells.setdefault((s, t, b), []).append(y)
    v = np.full((max(k[0] for k in cells) + 1, 4, 4), np.nan)
    for k, ys in cells.items():
        v[k] = np.median(ys)
    for _ in range(30):
        old = v.copy()
        for axis, sign in ((1, 1), (2, -1), (0, -1)):
            for index in np.ndindex(*np.delete(v.shape, axis)):
                line = v[tuple(np.insert(np.array(index, object), axis, slice(None)))]
                best = np.nan
                for i, x in enumerate(line):
                    best = x if math.isnan(best) else best if math.isnan(x) else max(best, x) if sign > 0 else min(best, x)
                    line[i] = best
        if np.array_equal(old, v, equal_nan=True):
            break
    want = {(int(s), models.TIERS[t], models.BREAKS[b]): round(float(v[s, t, b]), 6) for s, t, b in np.argwhere(~np.isnan(v))}
    got = {(r.season, r.tier, r.break_class): r.projected for r in registry.queries()["monotone_projection"](spark, SF).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_nested_tuning(spark):
    """Every fold's ridge and error by a plain loop over folds, fitted on cells made here from the rows."""
    own = priced(spark)
    makers = sorted({r[6] for r in own})
    fold_of = {r.s: r.f for r in spark.createDataFrame([(m,) for m in makers], "s long").selectExpr("s", "cast(pmod(xxhash64(s), 5) as int) AS f").collect()}
    seasons = max(r[2] for r in own) + 1

    def fitted(train, ridge):
        cells = {}
        for r in train:
            n, sy = cells.get(r[2:5], (0, 0.0))
            cells[r[2:5]] = (n + 1, sy + r[5])
        c = np.array(list(cells))
        n, sy = np.array(list(cells.values())).T
        m = models._solve(c[:, 0], c[:, 1], c[:, 2], n, sy, ridge, rounds=200, seasons=seasons)
        return lambda r: m.season[r[2]] + m.tiers[: r[3]].sum() + m.breaks[: r[4]].sum()

    def error(train, test, ridge):
        price = fitted(train, ridge)
        return sum((price(r) - r[5]) ** 2 for r in test)

    by = {k: [r for r in own if fold_of[r[6]] == k] for k in sorted(set(fold_of.values()))}
    want = {}
    for outer in by:
        rest = [k for k in by if k != outer]
        losses = {ridge: sum(error([r for j in rest if j != k for r in by[j]], by[k], ridge) for k in rest) for ridge in (0.1, 1.0, 10.0, 100.0)}
        best = min(losses, key=losses.get)
        want[outer] = (best, (error([r for k in rest for r in by[k]], by[outer], best) / len(by[outer])) ** 0.5)
    got = {r.fold: (r.ridge, r.rmse) for r in registry.queries()["nested_tuning"](spark, SF).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()} and all(abs(got[k][1] - want[k][1]) < 2e-5 for k in want)


def test_hierarchical_lookup(spark):
    """The prices are those of the least squares over the rows, pulls included."""
    own = priced(spark)
    s, t, b, y = (np.array([r[k] for r in own]) for k in (2, 3, 4, 5))
    seasons = s.max() + 1
    x, p = hierarchy.design(s, t, b, seasons), hierarchy.pulls(seasons, 1.0, 10.0, 10.0)
    w = hierarchy.non_negative(x.T @ x + p.T @ p, x.T @ y)
    slope = x.T @ (x @ w - y) + p.T @ (p @ w)
    assert np.abs(slope[np.r_[True, w[1:] > 0]]).max() < 1e-5 and slope[1:].min() > -1e-5  # no step in either direction is better
    want = dict(zip(zip(s.tolist(), t.tolist(), b.tolist()), np.exp(x @ w)))
    got = registry.queries()["hierarchical_lookup"](spark, SF).collect()
    assert len(got) == len(own) and all(abs(r.predicted / want[r.season, models.TIERS.index(r.tier), models.BREAKS.index(r.break_class)] - 1) < 1e-5 for r in got)


@pytest.mark.parametrize("name", ["percentage_prices", "adjusted_prices"])
def test_percentages_explain_the_prices(spark, name):
    """Factors multiply to the price; the fit's own slopes on the rows are what its ridge and bounds leave."""
    y = {}
    for r in priced(spark):
        y.setdefault(r[:2], []).append(r)
    got = [r for r in registry.queries()[name](spark, SF).collect() if len(y[r.l_orderkey, r.l_linenumber]) == 1]
    assert len(got) == sum(len(v) == 1 for v in y.values())
    for r in got:
        product = math.prod(r[c] for c in r.__fields__ if c.endswith("_factor")) * r.base_price
        assert abs(r.predicted / product - 1) < 1e-3
    off = np.array([y[r.l_orderkey, r.l_linenumber][0][5] - math.log(r.predicted) for r in got])
    season = np.array([y[r.l_orderkey, r.l_linenumber][0][2] for r in got])
    base = {s: {round(r.base_price, 4) for r, k in zip(got, season) if k == s} for s in set(season.tolist())}
    assert all(len(v) == 1 for v in base.values())  # a season has one base
    prices = [base[s].copy().pop() for s in sorted(base)]
    assert all(a >= b - 1e-3 for a, b in zip(prices, prices[1:])) and abs(off.mean()) < 0.2


def test_robust_lookup(spark):
    """No season, tier or class is priced against its order, and prices are nearer to the middle than to the mean of far values."""
    got = registry.queries()["robust_lookup"](spark, SF).collect()
    price = {(r.season, models.TIERS.index(r.tier), models.BREAKS.index(r.break_class)): r.predicted for r in got}
    for (s, t, b), v in price.items():
        assert price.get((s, t + 1, b), v) >= v - 0.01 and price.get((s, t, b + 1), v) <= v + 0.01


def test_cross_validated_prices(spark):
    rows_ = registry.queries()["cross_validated_prices"](spark, SF).collect()
    own = {}
    for r in priced(spark):
        own.setdefault(r[:2], []).append(r)
    folds = {}
    for r in rows_:
        for o in own[r.l_orderkey, r.l_linenumber] if len(own[r.l_orderkey, r.l_linenumber]) == 1 else ():
            folds.setdefault(o[6], set()).add(r.fold)
    assert len(rows_) == sum(map(len, own.values())) and all(len(f) == 1 for f in folds.values()) and all(r.predicted > 0 and r.ridge in (0.1, 1.0, 10.0, 100.0) for r in rows_)


def test_sequence_pairs(spark):
    """Pairs don't cross, and their scores and the rows left alone make up the alignment's score."""
    n = {}
    for r in rows(spark, "conversations"):
        n[r.conv_id] = n.get(r.conv_id, 0) + 1
    pairs = {}
    for r in registry.queries()["sequence_pairs"](spark, SF).collect():
        pairs.setdefault(r.conv_id, []).append((r.user_turn, r.other_turn, r.similarity))
    scores = {r.conv_id: r.score for r in registry.queries()["sequence_align"](spark, SF).collect()}
    for conv, size in n.items():
        mine = sorted(pairs.get(conv, []))
        assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(mine, mine[1:]))
        assert abs(sum(3 * x + 0.2 for *_, x in mine) - 0.65 * (size - 2 * len(mine)) - scores[conv]) < 1e-4
