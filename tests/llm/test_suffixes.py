import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import registry, suffixes


def brute(rows, match):
    """For each (id, text) the removed runs and what stays: every window is looked up."""
    first, texts = {}, [(i, (t or "").encode()) for i, t in rows]
    order = lambda i: (i is None, i or 0)
    for i, t in texts:
        for k in range(len(t) - match + 1):
            place = (order(i), k)
            first[t[k : k + match]] = min(first.get(t[k : k + match], place), place)
    out = []
    for i, t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - match + 1):
            if first[t[k : k + match]] < (order(i), k):
                gone[k : k + match] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[False], gone[:-1], [False]]).astype(int)))
        out.append((i, tuple(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)), bytes(b for b, g in zip(t, gone, strict=False) if not g)))
    return sorted(out, key=repr)


def run(docs, match, gram):
    return sorted(((r.doc_id, tuple((s.start, s.end) for s in r.spans), bytes(r.kept)) for r in suffixes.dedup(docs, match, gram).collect()), key=repr)


def corpus(seed):
    rng = random.Random(seed)
    letters = "abcdefg hij é"
    new = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passages = [new(rng.randint(20, 90)) for _ in range(8)]
    texts = []
    for _ in range(120):
        parts = [new(rng.randint(0, 60)) if rng.random() < 0.6 else rng.choice(passages)[rng.randint(0, 10) :] for _ in range(rng.randint(0, 6))]
        texts.append("".join(parts))
    texts += [texts[3], texts[5][:-1], "x" * 200, "ab" * 90, texts[7] + texts[7], "", "y" * 19, "y" * 20, "y" * 21]
    return [(k, t) for k, t in enumerate(texts)]


SCHEMA = "doc_id long, text string, spans int, shard string"


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_windows(spark, monkeypatch, seed):
    monkeypatch.setattr(suffixes, "WINDOW_SHARD", 1500)
    monkeypatch.setattr(suffixes, "RUN_SHARD", 1500)
    monkeypatch.setattr(suffixes, "BATCH", 64)
    rows = corpus(seed)
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(5)
    got = suffixes.dedup(docs, 20, 8)
    assert got.columns == [*docs.columns, "spans_", "kept"]
    assert sorted(((r.doc_id, tuple((s.start, s.end) for s in r.spans_), bytes(r.kept)) for r in got.collect()), key=repr) == brute(rows, 20)


def test_hot_anchors(spark, monkeypatch):
    for name, value in (("HOT", 3), ("SAMPLED", 1), ("WINDOW_SHARD", 1500), ("RUN_SHARD", 1000)):
        monkeypatch.setattr(suffixes, name, value)
    rng = random.Random(9)
    rows = [(k, "".join(rng.choice("abcd") for _ in range(15)) + "the common passage of all" + "".join(rng.choice("abcd") for _ in range(rng.choice([0, 3, 40])))) for k in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert run(docs, 20, 8) == brute(rows, 20)


def test_odd_rows(spark):
    long, other = "abcdefghij" * 30 + "klm" * 40, "zyxw" * 60 + "abcdefghij" * 30
    rows = [(1, None), (2, ""), (3, long), (None, long), (None, long + "!"), (4, "short"), (5, other), (5, long[40:]), (5, other), (6, "é" * 80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert run(docs, 100, 32) == brute(rows, 100)
    assert run(docs.limit(0), 100, 32) == []


def test_a_long_text(spark):
    rng = random.Random(4)
    body = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(300_000))
    text = body + " again " + body[1000:200_000]
    got = run(spark.createDataFrame([(1, text)], "doc_id long, text string"), 100, 32)
    (_, spans, kept), at = got[0], len(body) + 7
    assert spans == ((at, at + 199_000),) and kept.decode() == body + " again "


def test_family_has_logarithmic_levels():
    rng = np.random.default_rng(2)
    pool, family = rng.integers(97, 99, 20_000).astype(np.uint8), suffixes.Family(24)
    found = np.concatenate([family.add(pool, np.arange(k, min(k + 500, 19_977)), np.zeros(min(500, 19_977 - k), np.int64), np.arange(k, min(k + 500, 19_977))) for k in range(0, 19_977, 500)])
    seen, want = set(), []
    for k in range(19_977):
        window = pool[k : k + 24].tobytes()
        want.append(window in seen)
        seen.add(window)
    assert found.tolist() == want and len(family.levels) <= 6
    assert sum(len(level[1]) for level in family.levels) == len(seen)


def test_documents(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = [(i, len((dict(rows)[i] or "").encode()), sum(b - a for a, b in s), len(s), hashlib.sha256(k).hexdigest()) for i, s, k in brute(rows, 100)]
    got = registry.op13_suffix_array_dedup(spark, sf).select("doc_id", "n_bytes", "n_removed", "n_spans", F.col("kept_sha256"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
