import random
import re

from marlstone.llm import ngramjoin
from marlstone.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, width, per_cent):
    sets = {}
    for d, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOWER))
        sets[d] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= per_cent * len(x | y):
                a_, b_ = find(a), find(b)
                root[max(a_, b_)] = min(a_, b_)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def check(spark, rows, width, per_cent):
    docs = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, component_id int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngramjoin.join(docs, width, per_cent).collect()}
    assert got == brute(rows, width, per_cent)


def test_planted(spark):
    rng = random.Random(2)
    passage = [f"p{k}" for k in range(60)]
    rows = [(1, None), (2, ""), (3, "one two"), (4, "One  TWO"), (5, "two one"), (6, " \n ")]
    d = 10
    for base in range(14):
        words = [f"b{base}w{rng.randrange(400)}" for _ in range(rng.choice([4, 12, 40, 150, 300]))]
        for _ in range(rng.choice([1, 2, 6, 30])):
            w = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, max(1, len(w) // 60)])):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            if rng.random() < 0.2:
                w = w[: int(len(w) * 0.9)]
            if rng.random() < 0.5:
                w = passage + w
            rows.append((d, " ".join(w)))
            d += 1
    rng.shuffle(rows)
    check(spark, rows, 4, 85)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    check(spark, rows, 5, 80)
    kept = {r.doc_id for r in ngramjoin.keep_one(docs).collect()}
    assert kept == {d for d, (_, c) in brute(rows, 5, 80).items() if d == c}


def test_copies_share_tokens_with_others(spark, monkeypatch):
    """A label of many groups: tokens that only it holds meet nothing, those that another label holds still do."""
    monkeypatch.setattr(ngramjoin, "GROUP", 4)
    rng = random.Random(9)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for d in range(60):
        w = list(base)
        w[d % 110] = f"c{d}"
        rows.append((d, " ".join(w)))
    rows += [(100 + k, " ".join(base[: 105 + k] + [f"t{k}{j}" for j in range(12)])) for k in range(8)]
    rows += [(200 + k, " ".join(rng.sample(base, 40))) for k in range(10)]
    for per_cent in (60, 80, 85):
        check(spark, rows, 4, per_cent)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in ngramjoin.join(docs).collect())
    assert got == [(0, 2, None), (1, 2, 1), (1, 2, 1), (2, 2, 1)]
    assert ngramjoin.keep_one(docs).count() == 2
    assert ngramjoin.join(docs.limit(0)).count() == 0


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (101, 102)], "a long, b long")
    got = {r.node: r.label for r in components(edges).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 103)}
