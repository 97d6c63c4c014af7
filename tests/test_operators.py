"""Operators on small tables: cases that the driver's tables don't hold."""

import json
import plistlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import history, identity, joins, metrics, models, ranking, robust
from marlstone.sources import files
from marlstone.streaming import snapshots


def test_outliers(spark):
    rows = [("a", float(100 + k)) for k in range(20)] + [("a", 1e6), ("a", 0.0)] + [("b", 5.0)] * 5 + [("b", 90.0)] + [("c", 1.0)] * 3
    got = robust.mad_outliers(spark.createDataFrame(rows, "g string, p double"), ["g"], "p").collect()
    assert {(r.g, r.p) for r in got if r.is_outlier} == {("a", 1e6), ("a", 0.0), ("b", 90.0)}
    assert all("small_group" in r.quality_flags for r in got if r.g == "c")


def test_identities_in_any_order(spark):
    rows = [(1, "a1", "p1"), (2, "a2", "p2"), (3, "a1", "p2"), (4, None, "p9"), (5, "a5", None)]
    for order in (rows, rows[::-1]):
        got = identity.components(spark.createDataFrame(order, "id long, account string, post string"), "id", ["account", "post"]).collect()
        assert {r.id: r.component for r in got} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}


def test_greedy_dedupe_keeps_what_only_a_dropped_row_blocks(spark):
    rows = [(1, "A", "p1", "t1"), (1, "B", "p1", "t2"), (1, "C", "p2", "t2")]
    got = identity.greedy_dedupe(spark.createDataFrame(rows, "component int, id string, post string, text string"), "component", ["id"], ["post", "text"]).collect()
    assert {r.id: r.kept for r in got} == {"A": True, "B": False, "C": True}


def test_asof_at_the_same_instant_and_before_all(spark):
    probes = spark.createDataFrame([(1, 5), (1, 3), (1, 1), (2, 9)], "k int, t int")
    rates = spark.createDataFrame([(1, 3, 0.5), (1, 4, None), (1, 5, 0.7)], "k int, t int, rate double")
    got = {(r.k, r.t): r.asof_rate for r in joins.asof_join(probes, rates, ["k"], "t", "rate").collect()}
    assert got == {(1, 5): 0.7, (1, 3): 0.5, (1, 1): None, (2, 9): None}


def test_merge_and_changes(spark):
    rows = [("s", 1, 1, 10.0, "TWD", "long", True), ("s", 2, 2, 10.0, "TWD", None, False), ("s", 3, 3, 10.0, "USD", None, None), ("s", 3, 4, None, "USD", None, False), ("q", 1, 5, 3.0, "TWD", None, None)]
    df = spark.createDataFrame(rows, "k string, at int, tie int, price double, currency string, note string, whole boolean")
    m = {r.k: r for r in history.snapshot_merge(df, ["k"], "at", "tie", F.col("at"), F.col("whole"), ["price", "currency"], ["note"]).collect()}
    s = m["s"]
    assert (s.price, s.currency, s.note) == (None, "USD", "long")  # a null in the newest row clears, an absent note doesn't
    assert (s.observation_count, s.first_seen_at, s.last_seen_at, s.seen_in_complete_snapshot, s.latest_snapshot_complete) == (3, 1, 3, True, False)
    assert m["q"].price == 3.0 and not m["q"].seen_in_complete_snapshot
    changed = history.change_history(df, ["k"], "at", "tie", ["price", "currency"]).orderBy("at").collect()
    assert [(r.k, r.at, r.currency) for r in changed] == [("s", 1, "TWD"), ("s", 3, "USD")]


def test_metrics_boundary(spark):
    df = spark.createDataFrame([(1000.0, 1100.0), (1000.0, 900.0), (1000.0, 1200.0)], "actual double, predicted double").withColumn("ape", metrics.ape(F.col("actual"), F.col("predicted")))
    one = metrics.accuracy(df, []).first()
    assert (one.hit10, one.hit20, one.median_ape) == (round(2 / 3, 6), 1.0, 0.1)
    failed = metrics.accuracy(df.union(spark.createDataFrame([(5.0, None, None)], df.schema)), []).first()
    assert failed.median_ape is None and failed.hit10 == 0.5
    both = metrics.accuracy(df.withColumn("k", F.when(F.col("predicted") > 1000, "up")), ["k"]).collect()
    assert {(r.k, r.n) for r in both} == {("up", 2), (None, 1)}


def test_release_gate(spark):
    row = lambda hit20, median, p90, failed=0: spark.createDataFrame([(hit20, median, p90, failed)], "hit20 double, median_ape double, p90_ape double, failed int")
    old = row(0.5, 0.2, 0.6)
    assert metrics.release_gate(old, row(0.5, 0.19, 0.6), row(0.4, 0.23, 0.9)).first().release == "publish"
    for new, frozen in ((row(0.5, 0.195, 0.6), old), (row(0.49, 0.1, 0.6), old), (row(0.5, 0.1, 0.61), old), (row(0.5, 0.1, 0.6, 1), old), (row(0.5, 0.1, 0.6), row(0.5, 0.24, 0.6)), (row(0.5, None, None), old)):
        assert metrics.release_gate(old, new, frozen).first().release == "retain_current"


def test_quantiles_equal_numpy_on_skewed_groups(spark, monkeypatch):
    monkeypatch.setattr(ranking, "BUCKETS", 8)
    monkeypatch.setattr(ranking, "FEW", 5)
    rng = np.random.default_rng(1)
    groups = {"a": rng.lognormal(0, 4, 700), "b": np.r_[np.full(300, 2.5), rng.normal(0, 1, 100)], None: np.array([7.0]), "c": np.array([1.0, 4.0]), "d": np.full(50, -3.0)}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("a", None), ("e", None)]
    qs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r.g: r for r in ranking.quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", qs).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert got[g].n == len(vs) and np.allclose([got[g][f"q{k}"] for k in range(5)], np.quantile(vs, qs), rtol=1e-12)
    assert ranking.quantiles(spark.createDataFrame([], "v double"), [], "v", [0.5]).collect() == []


def test_quantiles_of_odd_doubles_end(spark, monkeypatch):
    rounds = []
    told = ranking.through_table
    monkeypatch.setattr(ranking, "through_table", lambda df, name: rounds.append(name) or told(df, name))
    rng = np.random.default_rng(3)
    n = 20_000
    wide = np.r_[-1.7e308, 1.7e308, 5e-324, -5e-324, 0.0, rng.normal(0, 1, n) * 10.0 ** rng.integers(-300, 300, n)]
    groups = {"wide": wide, "inf": np.r_[rng.normal(0, 1, n), np.inf, np.inf, -np.inf], "nan": np.r_[rng.normal(5, 1, n), np.nan], "near": 1e9 + rng.random(n) * 1e-6, "all nan": np.full(9000, np.nan)}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs]
    qs = [0.0, 0.1, 0.5, 0.75, 1.0]
    got = {r.g: [r[f"q{k}"] for k in range(5)] for r in ranking.quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", qs).collect()}
    for g, vs in groups.items():
        ordered = np.sort(vs)  # NaN last
        for q, x in zip(qs, got[g], strict=True):
            low, high = ordered[int(np.floor(q * (len(vs) - 1)))], ordered[int(np.ceil(q * (len(vs) - 1)))]
            f = q * (len(vs) - 1) % 1
            want = low if f == 0 or low == high else low + f * (high - low)
            assert np.isclose(x, want, rtol=1e-9, atol=0, equal_nan=True), (g, q, x, want)
    assert len(rounds) < 20


def test_numbers_within_groups(spark):
    rows = [("hot", k * 7919 % 1000) for k in range(900)] + [(None, k) for k in range(5)] + [("one", 3)]
    got = ranking.numbered(spark.createDataFrame(rows, "g string, v int").repartition(5), ["g"], [F.col("v").desc()], "n").collect()
    by = {}
    for r in got:
        by.setdefault(r.g, []).append((r.n, r.v))
    assert all([n for n, _ in sorted(x)] == list(range(1, len(x) + 1)) and [v for _, v in sorted(x)] == sorted((v for _, v in x), reverse=True) for x in by.values())


def test_greedy_dedupe_equals_the_sequential_rule(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(3), k, rng.choice([None, *"abcdefghijkl"]), rng.choice([None, *range(12)]), rng.choice([None, *range(15)])) for k in range(150)] + [(7, k, "hot", k, k // 2) for k in range(60)]
    want, seen = {}, {}
    for c, k, *keys in rows:
        marks = {(i, v) for i, v in enumerate(keys) if v is not None}
        want[k, c] = not marks & seen.setdefault(c, set())
        if want[k, c]:
            seen[c] |= marks
    got = identity.greedy_dedupe(spark.createDataFrame(rows, "c int, id int, x string, y int, z int"), "c", ["id"], ["x", "y", "z"]).collect()
    assert {(r.id, r.c): r.kept for r in got} == want


def test_greedy_dedupe_settles_a_chain_in_few_rounds(spark, monkeypatch):
    tables = []
    told = identity.through_table
    monkeypatch.setattr(identity, "through_table", lambda df, name: tables.append(name) or told(df, name))
    rows = [(0, k, f"a{(k + 1) // 2}", f"b{k // 2}") for k in range(400)]
    got = identity.greedy_dedupe(spark.createDataFrame(rows, "c int, id int, x string, y string"), "c", ["id"], ["x", "y"]).collect()
    assert {r.id: r.kept for r in got} == {k: k % 2 == 0 for k in range(400)}
    assert tables.count("undecided") <= 3 and len(tables) < 25


def test_gaps_are_filled_from_few_points(spark):
    rows = [(1, k, None if k in (0, 1, 4, 5, 9) else float(k * k)) for k in range(10)] + [(2, 1, None), (2, 2, 7.0), (3, 1, None)]
    got = {(r.g, r.x): r.filled for r in history.interpolate(spark.createDataFrame(rows, "g int, x int, y double"), ["g"], "x", "y").collect()}
    assert (got[1, 0], got[1, 1], got[1, 4], got[1, 5], got[1, 9]) == (-6.0, -1.0, 18.0, 27.0, 79.0) and got[2, 1] == 7.0 and got[3, 1] is None


def test_chains_of_any_length(spark):
    rows = [(k, k - 1 if k else None) for k in range(90)] + [(200, 201), (201, 200), (300, 999), (400, 200)]
    got = {r.k: (r.root, r.depth, r.cycle) for r in identity.root_chain(spark.createDataFrame(rows, "k int, p int"), "k", "p").collect()}
    assert all(got[k] == (0, k, False) for k in range(90)) and got[300] == (300, 0, False)
    assert all(got[k] == (None, None, True) for k in (200, 201, 400))


def test_longest_alias_of_any_size(spark):
    texts = [(1, "the quick brown fox jumps over the lazy dog tonight"), (2, "concatenate xy"), (3, ""), (4, None), (5, "quick brown")]
    aliases = [(1, "quick brown fox jumps over the lazy"), (2, "quick brown"), (3, "cat"), (4, ""), (5, "y"), (6, "own fox jumps"), (7, "nothing of it"), (8, "xy"), (9, "onc")]
    got = joins.longest_contained(spark.createDataFrame(texts, "t int, text string"), "t", "text", spark.createDataFrame(aliases, "a int, alias string"), "a", "alias").collect()
    want = set()
    for t, x in texts:
        hits = [(len(s), a) for a, s in aliases if s and x and s in x]
        want |= {(t, a, n) for n, a in hits if n == max(hits)[0]}
    assert {(r.t, r.a, r.alias_length) for r in got} == want


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(0, 1, (120, 5)), 2)
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(500, None), (501, [0.0] * 5)]
    got = joins.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0, 3, shard=25, block=2).collect()
    u = x.astype(np.float32).astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    for q in range(0, 120, 20):
        best = sorted((-round(float(u[q] @ u[k]), 9), k) for k in range(120) if k != q)[:3]
        assert [(r.ref, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r["query"] == q] == [(k, -s) for s, k in best]


def test_safe_names(spark):
    cases = {"a/b:c": "a-b-c", " con ": "con-帳號", "COM7.txt": "COM7.txt-帳號", "console": "console", "x. . ": "x", "\u0001\u007f": "--", " .. ": "未命名", "": "未命名", "lpt0": "lpt0"}
    got = spark.createDataFrame([(k,) for k in cases], "s string").select("s", T.safe_name(F.col("s")).alias("n")).collect()
    assert {r.s: r.n for r in got} == cases


def test_page_breaks_equal_the_sequential_rule(spark, monkeypatch):
    from marlstone.plans import evaluation

    monkeypatch.setattr(evaluation, "CHUNK", 7)
    got = {r.p_partkey: (r.row, r.page) for r in evaluation.page_breaks(spark, "/root/testdata/sf0.001").collect()}
    parts = sorted(spark.read.parquet("/root/testdata/sf0.001/part.parquet").collect(), key=lambda r: (r.p_brand, r.p_size, r.p_partkey))
    row, used, brand, want = 0, 0, None, {}
    for p in parts:
        row, used = (0, 0) if p.p_brand != brand else (row, used)
        brand, w = p.p_brand, min(len(p.p_name), 60)
        row, used = (row, used + w) if used + w <= 60 else (row + 1, w)
        want[p.p_partkey] = (row, row // 4)
    assert got == want


def test_numbers(spark):
    df = spark.createDataFrame([("1,234.5",), ("1.234",), ("12,50",), ("1.234.567,8",), ("x",)], "s string")
    assert [r[0] for r in df.select(T.localized_number(F.col("s"))).collect()] == [1234.5, 1234.0, 12.5, 1234567.8, None]
    assert [r[0] for r in spark.createDataFrame([("ﬁ Ａ　b",), (None,)], "s string").select(T.normalize(F.col("s"))).collect()] == ["fiab", None]


def test_model_is_monotone(spark):
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    m = models.fit_cells(models.cells(models.priced_rows(li)))
    assert (m.tiers >= 0).all() and (m.breaks <= 0).all() and m.rounds < 5000
    grid = [(s, t, b, float((s * 7 + k * 3 + j) % 5)) for s in range(3) for k, t in enumerate(models.TIERS) for j, b in enumerate(models.BREAKS)]
    early = spark.createDataFrame([("1991-02-03", 10.0 * k, 5.0 * k, 0.01 * k) for k in range(1, 9)] + [(None, 1.0, 1.0, 0.0)], "l_shipdate string, l_extendedprice double, l_quantity double, l_discount double").withColumn("l_shipdate", F.col("l_shipdate").cast("date"))
    assert len(models.fit_cells(models.cells(models.priced_rows(early))).season) == 1
    got = {(r.season, r.tier, r.break_class): r.projected for r in models.project(spark.createDataFrame(grid, "season int, tier string, break_class string, m double")).collect()}
    assert all(got[s, models.TIERS[k], b] <= got[s, models.TIERS[k + 1], b] for s in range(3) for k in range(3) for b in models.BREAKS)


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿id,content\n1,"two\nlines, ""quoted"""\n2\n', encoding="utf-8")
    rows = files.read_csv(spark, str(tmp_path / "a.csv"), "id string, content string").collect()
    assert [(r.id, r.content) for r in rows] == [("1", 'two\nlines, "quoted"'), ("2", None)]
    for k, complete in ((1, "true"), (2, "false")):
        (tmp_path / "snap" / f"s{k}").mkdir(parents=True)
        (tmp_path / "snap" / f"s{k}" / "public-listings.jsonl").write_text(f'{{"source":"a","listing_id":"{k}"}}\n\n{{"source":null,"listing_id":"9"}}\n')
        (tmp_path / "snap" / f"s{k}" / "summary.json").write_text(f'{{\n  "schema_version": 1,\n  "collected_at": "2024-01-0{k}T00:00:00Z",\n  "snapshot_complete": {complete},\n  "by_source": {{\n    "a": 1\n  }}\n}}\n')
    got = files.read_snapshots(spark, str(tmp_path / "snap"), "source string, listing_id string").collect()
    assert {(r.snapshot_id, r.listing_id, r.complete) for r in got} == {("s1", "1", True), ("s2", "2", False)}
    main = {"WebResourceURL": "https://x.example/a", "WebResourceMIMEType": "text/html", "WebResourceData": b"<p>"}
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "1.webarchive").write_bytes(plistlib.dumps({"WebMainResource": main}, fmt=plistlib.FMT_BINARY))
    (tmp_path / "w" / "2.webarchive").write_bytes(b"no")
    read = {r.path[-12:]: (r.body, r.reason) for r in files.read_web_archives(spark, str(tmp_path / "w"), "https://x.example/", "text/html").collect()}
    assert read == {"1.webarchive": ("<p>", None), "2.webarchive": (None, "unreadable")}
    rates = spark.createDataFrame([("20240101", 30.0, 1.1, 7.5, None), ("bad", 1.0, 1.0, 1.0, 1.0)], "date string, usd_twd double, eur_usd double, usd_hkd double, cny_twd double")
    assert {(r.currency, round(r.rate, 6)) for r in files.rates_long(rates).collect()} == {("USD", 30.0), ("EUR", 33.0), ("HKD", 4.0)}


def test_guarded_writes(spark, tmp_path):
    at = str(tmp_path / "t")
    assert not files.checked_or_written(spark.range(5), at, write=False) and not (tmp_path / "t").exists()
    assert not files.checked_or_written(spark.range(5), at, write=True)
    assert files.checked_or_written(spark.range(5), at, write=False)
    assert not files.checked_or_written(spark.range(6), at, write=True) and files.checked_or_written(spark.range(6), at, write=True)
    with pytest.raises(Exception, match="exists"):
        files.write_new(spark.range(3), at)
    with pytest.raises(ValueError):
        files.write_not_smaller(spark.range(3), at)
    assert spark.read.parquet(at).count() == 6 and not (tmp_path / "t.new").exists()
    files.write_not_smaller(spark.range(7), at)
    assert spark.read.parquet(at).count() == 7
    (tmp_path / "t").rename(tmp_path / "t.old")  # as a failure between the two renames leaves it
    with pytest.raises(ValueError):
        files.write_not_smaller(spark.range(2), at)
    assert spark.read.parquet(at).count() == 7


def test_paths_stay_inside(spark):
    assert files.within("work", "work/a/b/") == "work/a/b"
    for bad in ("elsewhere", "work/../x", "workshop/a"):
        with pytest.raises(ValueError):
            files.within("work", bad)


def test_snapshots_written_and_read_again(spark, tmp_path):
    rows = spark.createDataFrame([("a", "1", 5.0), ("a", "2", None)], "source string, listing_id string, price double")
    root = f"file://{tmp_path}"
    files.write_snapshot(rows, root, "s1", "2024-01-01T00:00:00Z", True)
    files.write_snapshot(rows.limit(1), root, "s2", "2024-01-02T00:00:00Z", False)
    assert json.loads((tmp_path / "latest.json").read_text()) == {"snapshot_id": "s1"}
    assert json.loads((tmp_path / "snapshots/s2/summary.json").read_text())["rows"] == 1
    got = files.read_snapshots(spark, f"{root}/snapshots", "source string, listing_id string, price double", "public-listings.jsonl/*.json").count()
    assert got in (0, 3)
    with pytest.raises(Exception, match="exists"):
        files.write_snapshot(rows, root, "s1", "2024-01-01T00:00:00Z", True)


def test_backup_and_stable_lines(spark):
    e = spark.createDataFrame([("b", "2"), ("a", None)], "k string, v string")
    lines = [json.loads(r.line) for r in files.backup_lines(e, "k", "v", 1, "2024-01-01").collect()]
    assert lines[1:] == [{"key": "a", "value": None}, {"key": "b", "value": "2"}] and lines[0]["entries"] == 2
    again = [json.loads(r.line) for r in files.backup_lines(e.orderBy("k").repartition(3), "k", "v", 1, "2024-01-01").collect()]
    assert again == lines
    assert [r.line for r in files.stable_lines(e.select("v", "k"), ["k"]).collect()] == ['{"k":"a"}', '{"k":"b","v":"2"}']


def test_snapshot_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for k, price in ((1, 10.0), (2, 12.0)):
        (src / f"{k}.json").write_text(f'{{"source":"a","listing_id":"x","price":{price},"observed_at":"2024-01-0{k}T00:00:00Z"}}\n')
        snapshots.stream(spark, str(src), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    r = spark.read.parquet(str(tmp_path / "out" / "v=1")).first()
    assert (r.price, r.seen, r.first_seen_at.day, r.last_seen_at.day) == (12.0, 2, 1, 2)


def brute_alignment(a, b):
    like = lambda x, y: len(set(x) & set(y)) / (len(set(x) | set(y)) or 1)
    s = np.zeros((len(a) + 1, len(b) + 1))
    step = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        s[i, 0] = s[i - 1, 0] - 0.65
    for j in range(1, len(b) + 1):
        s[0, j] = s[0, j - 1] - 0.65
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            pair, over, before = s[i - 1, j - 1] + like(a[i - 1], b[j - 1]) * 3 + 0.2, s[i - 1, j] - 0.65, s[i, j - 1] - 0.65
            step[i, j] = 1 if pair >= over and pair >= before else 2 if over >= before else 3
            s[i, j] = (pair, over, before)[step[i, j] - 1]
    pairs, i, j = set(), len(a), len(b)
    while i and j:
        if step[i, j] == 1:
            pairs.add((i - 1, j - 1, round(like(a[i - 1], b[j - 1]), 9)))
        i, j = i - (step[i, j] != 3), j - (step[i, j] != 2)
    return round(float(s[-1, -1]), 6), pairs


@pytest.mark.parametrize("block", [5, 256])
def test_alignment_in_blocks_equals_the_whole_matrix(spark, monkeypatch, block):
    from marlstone.operators import sequences

    monkeypatch.setattr(sequences, "BLOCK", block)
    rng = random.Random(block)
    groups, rows = {}, []
    for g in range(8):
        base = [[rng.choice("abcdefgh") for _ in range(rng.randint(0, 4))] for _ in range(rng.choice([0, 1, 4, 12, 17]))]
        a, b = ([w for w in base if rng.random() < 0.8] for _ in "ab")
        groups[g] = (a, b)
        rows += [(g, 2 * k, True, w) for k, w in enumerate(a)] + [(g, 2 * k + 1, False, w or None) for k, w in enumerate(b)]
    scores, pairs = sequences.aligned(spark.createDataFrame(rows, "g int, o int, left boolean, w array<string>").repartition(4), "g", "o", F.col("left"), "w")
    got = {}
    for r in pairs.collect():
        got.setdefault(r.g, set()).add((r.left // 2, r.right // 2, round(r.similarity, 9)))
    want = {g: brute_alignment(a, b) for g, (a, b) in groups.items() if a or b}
    assert {r.g: round(r.score, 6) for r in scores.collect()} == {g: s for g, (s, _) in want.items()}
    assert {g: got.get(g, set()) for g in want} == {g: p for g, (_, p) in want.items()}


def test_sequence_align_uses_all_words_of_a_turn(spark, tmp_path):
    from marlstone.plans import identities

    words = ["".join(chr(97 + k // 26**p % 26) for p in range(3)) for k in range(1100)]
    rows = [(1, 0, "user", " ".join(words[:400] + words[800:])), (1, 1, "assistant", " ".join(words[400:]))]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = identities.sequence_align(spark, str(tmp_path)).first()
    assert got.score == round(3 * 300 / 1100 + 0.2, 6)
