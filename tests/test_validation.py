"""Cross-validation against a plain loop over folds."""

import numpy as np
from pyspark.sql import functions as F

from marlstone.operators import models, validation


def folds_of(sizes, n):
    """Groups in order of falling size (then name) to their folds, to and fro."""
    out = {}
    for r, g in enumerate(sorted(sizes, key=lambda g: (-sizes[g], g))):
        out[g] = min(r % (2 * n), 2 * n - 1 - r % (2 * n))
    return out


def test_against_a_plain_loop(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(400):
        g, s, t, b = int(rng.zipf(1.6) % 30), int(rng.integers(0, 5)), int(rng.integers(0, 4)), int(rng.integers(0, 4))
        rows.append((k, f"g{g}", s, models.TIERS[t], models.BREAKS[b], float(9 - 0.2 * s + 0.3 * t - 0.1 * b + rng.normal(0, 0.4))))
    df = spark.createDataFrame(rows, "k int, g string, season int, tier string, break_class string, y double").repartition(5)
    ridges = (0.1, 30.0)
    got, tuned = validation.cross_validated(df, "g", ridges, outer=4, inner=3)
    got, tuned = got.collect(), {(r.outer, r.config): r for r in tuned.collect()}
    count = lambda rs: {g: sum(r[1] == g for r in rs) for g in {r[1] for r in rs}}
    outer = folds_of(count(rows), 4)
    assert {r.k: r.outer for r in got} == {r[0]: outer[r[1]] for r in rows} and len(got) == len(rows)

    def fitted(train, ridge):
        cells = {}
        for _, _, s, t, b, y in train:
            n, sy = cells.get((s, t, b), (0, 0.0))
            cells[s, t, b] = (n + 1, sy + y)
        table = {"season": [c[0] for c in cells], "tier": [c[1] for c in cells], "break_class": [c[2] for c in cells], "n": [v[0] for v in cells.values()], "sy": [v[1] for v in cells.values()]}
        m = models._solve(*models._columns(table), ridge, rounds=500, seasons=5)
        return lambda r: m.season[r[2]] + np.r_[0, m.tiers.cumsum()][models.TIERS.index(r[3])] + np.r_[0, m.breaks.cumsum()][models.BREAKS.index(r[4])]

    want = {}
    for o in range(4):
        train = [r for r in rows if outer[r[1]] != o]
        inner = folds_of(count(train), 3)
        ranks = []
        for c, ridge in enumerate(ridges):
            ape = []
            for i in range(3):
                price = fitted([r for r in train if inner[r[1]] != i], ridge)
                ape += [abs(np.exp(price(r)) / np.exp(r[5]) - 1) for r in train if inner[r[1]] == i]
            ranks.append((np.quantile(ape, 0.5), np.quantile(ape, 0.9), c))
            assert np.allclose((tuned[o, c].median_ape, tuned[o, c].p90_ape), ranks[-1][:2])
        best = min(ranks)[2]
        assert tuned[o, best].chosen
        price = fitted(train, ridges[best])
        want |= {r[0]: (ridges[best], np.exp(price(r))) for r in rows if outer[r[1]] == o}
    assert all(r.ridge == want[r.k][0] and np.isclose(r.predicted, want[r.k][1]) for r in got)


def test_groups_stay_together_and_folds_are_even(spark):
    rows = spark.range(1000).select("id", (F.col("id") % 37).alias("g"))
    got = validation.balanced_folds(rows, [], "g", 5, "fold").groupBy("fold").agg(F.count("*").alias("n"), F.collect_set("g").alias("g")).collect()
    assert len(got) == 5 and max(r.n for r in got) < 1.3 * min(r.n for r in got) and sum(len(r.g) for r in got) == 37
