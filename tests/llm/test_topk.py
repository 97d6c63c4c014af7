import math
import random

from pyspark.sql import functions as F

from marlstone.llm import topk


def brute(rows, every, k):
    ok = [(i, [math.floor(256 * float(v)) for v in x]) for i, x in rows if i is not None and x and all(v is not None and math.isfinite(v) for v in x)]
    out = []
    for q, a in ok:
        if q % every == 0:
            scored = sorted((-sum(u * v for u, v in zip(a, b, strict=True)), i) for i, b in ok if i != q)[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def run(docs, every, k=5):
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(docs, F.col("vec_id") % every == 0, k).collect())


def test_random(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 60)
    monkeypatch.setattr(topk, "BLOCK", 10)
    monkeypatch.setattr(topk, "LEAF", 8)
    rng = random.Random(4)
    rows = [(k, [rng.choice([0.0, 0.25, -0.5, 0.013 * rng.randint(-50, 50)]) for _ in range(6)]) for k in range(400)]
    rows += [(k, rows[0][1]) for k in range(400, 420)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int")
    assert run(docs, 9) == brute(rows, 9, 5)


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, [0.5, None]), (2, None), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [-1.0, 0.1]), (None, [1.0, 1.0]), (50, [1.0, 2.0])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert run(docs, 50) == brute(rows, 50, 5) and len(run(docs, 50)) == 4
    assert run(docs.limit(0), 50) == []
    assert run(docs.filter("vec_id = 0"), 50) == []


def test_two_queries_of_one_id_and_a_common_vector(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 20)
    monkeypatch.setattr(topk, "CALL", 2)
    monkeypatch.setattr(topk, "LEAF", 4)
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [0.0, 1.0]), *((k, [k / 100, 1 - k / 90]) for k in range(1, 60)), *((k, [0.5, 0.5]) for k in range(60, 130))]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(docs, F.col("vec_id") % 50 == 0, 5).collect()
    assert len({(r.query_id, r["query"]) for r in got}) == 4 and len(got) == 20
    x = [(i, [math.floor(256 * v) for v in e]) for i, e in rows]
    want = []
    for q, a in [(0, [256, 0]), (0, [0, 256]), *(r for r in x if r[0] in (50, 100))]:
        best = sorted((-sum(u * v for u, v in zip(a, b, strict=True)), i) for i, b in x if i != q)[:5]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == sorted(want)


def test_embeddings(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in docs.collect()]
    assert run(docs, 50) == brute(rows, 50, 5)
