import hashlib
import math
import random
import re
import zlib

import numpy as np

from marlstone.llm import importance

WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def bag(text, low=1, high=1):
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    words = WORD.findall(lower)
    return len(words), [zlib.crc32(b" ".join(words[k : k + n])) % 10_000 for n in range(low, high + 1) for k in range(len(words) - n + 1)]


def brute(rows, target, per_cent=10, seed=2024, low=1, high=1, least=20):
    bags = [(i, *bag(t, low, high)) for i, t in rows]
    s, t = np.zeros(10_000), np.zeros(10_000)
    for _, _, b in bags:
        np.add.at(s, b, 1)
    for x in target:
        np.add.at(t, bag(x, low, high)[1], 1)
    gain = [math.floor(1000 * math.log((t[k] + 1) * (s.sum() + 10_000) / ((s[k] + 1) * (t.sum() + 10_000)))) for k in range(10_000)]
    out = []
    for i, words, b in bags:
        weight = sum(gain[k] for k in b) // len(b) if b else 0
        h = None if i is None else int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
        score = None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(b), weight, score, words])
    may = sorted((r for r in out if r[0] is not None and r[4] >= least), key=lambda r: (-r[3], r[0], r[1]))
    ranks = {id(r): k for k, r in enumerate(may[: per_cent * len(may) // 100], 1)}
    return sorted(((i, n, w, s, ranks.get(id(r))) for r in out for i, n, w, s, _ in [r]), key=repr)


def run(docs, target, **options):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in importance.resample(docs, target, **options).collect()), key=repr)


def test_crc32():
    rng = random.Random(1)
    words = [bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 2, 5, 47, 48, 49, 200]))) for _ in range(300)]
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    starts = ends - [len(w) for w in words]
    before = np.array([zlib.crc32(b"x" * k) for k in range(len(words))], np.uint32)
    assert importance.crc32_on(before, data, starts, ends).tolist() == [zlib.crc32(w, int(b)) for w, b in zip(words, before, strict=True)]


def test_sums_of_planes_are_exact():
    rng = np.random.default_rng(5)
    gain, n = rng.integers(-20_000, 20_000, 10_000), 40
    rows = np.repeat(np.arange(n), 300)
    bucket = np.concatenate([rng.choice(10_000, 300, replace=False) for _ in range(n)])
    times = rng.integers(1, 5000, n * 300)
    got = importance.sums(rows, bucket, times, n, importance.planes(np.maximum(gain, 0)), importance.planes(np.maximum(-gain, 0)), 10_000)
    want = np.zeros(n, np.int64)
    np.add.at(want, rows, times * gain[bucket])
    assert got.tolist() == want.tolist()


def test_random_texts(spark):
    rng = random.Random(2)
    words = [*"the of cat Dog naïve 数据 x1 zz ZZ".split(), "über-all", "w" * 60]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([0, 5, 19, 20, 21, 80, 400])))) for k in range(300)]
    rows += [(7, rows[7][1]), (7, "other words"), (None, "null id " * 30), (900, None), (901, ""), (902, "!?. ")]
    target = ["the cat of data", "naïve Dog", None, ""]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, weight int, rank string")
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    assert run(docs, wanted) == brute(rows, target)
    assert run(docs, wanted, per_cent=35, seed=7, low=1, high=3, least_words=5) == brute(rows, target, 35, 7, 1, 3, 5)
    kept = importance.drawn(docs, wanted)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in brute(rows, target) if r[4]}
    assert run(docs.limit(0), wanted) == [] and run(docs, wanted.limit(0)) == brute(rows, [])


def test_documents(spark):
    docs, target = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    assert run(docs, target) == brute([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()])
