import hashlib
import math
import random

import numpy as np
from pyspark.sql import functions as F

from marlstone.llm import codes, registry


def brute(rows, parts=4, entries=256, rounds=4, scale=1024):
    """Codes, errors and codebooks with every distance worked out, in Python integers."""
    ok = [(i, [math.floor(scale * float(v)) for v in x]) for i, x in rows if x and all(v is not None and math.isfinite(v) for v in x)]
    if not ok:
        return [], []
    width = len(ok[0][1])
    cuts = [p * width // parts for p in range(parts + 1)]
    first = sorted(ok, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[x[cuts[p] : cuts[p + 1]] for _, x in first] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x[cuts[p] : cuts[p + 1]], e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            mine = {}
            for _, x in ok:
                mine.setdefault(nearest(p, x)[1], []).append(x[cuts[p] : cuts[p + 1]])
            books[p] = [[sum(c) // len(c) for c in zip(*mine[k], strict=True)] if k in mine else e for k, e in enumerate(books[p])]
    coded = [[nearest(p, x) for p in range(parts)] for _, x in ok]
    return sorted(((i, tuple(k for _, k in c), sum(d for d, _ in c)) for (i, _), c in zip(ok, coded, strict=True)), key=repr), books


def run(docs, **options):
    coded, books, scans = codes.compress(docs, "vec_id", **options)
    return sorted(((r.vec_id, tuple(r.code), r.error) for r in coded.collect()), key=repr), [b.tolist() for b in books], scans


def test_bounds_change_nothing_and_save_scans(spark):
    rng = random.Random(3)
    centres = [[rng.uniform(-1, 1) for _ in range(8)] for _ in range(40)]
    rows = [(k, [c + rng.gauss(0, 0.01) for c in rng.choice(centres)]) for k in range(900)] + [(3, [0.5] * 8), (900, [0.5] * 8), (901, [0.5] * 8)]
    got, books, scans = run(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), entries=64, rounds=5)
    want, want_books = brute(rows, entries=64, rounds=5)
    assert got == want and books == want_books
    assert scans[-1] < scans[0] / 3  # late rounds scan few groups


def test_ties_and_few_vectors(spark):
    rows = [(k, [float(k % 3), 0.0, float(k % 2), 1.0]) for k in range(12)]
    got, books, _ = run(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert (got, books) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, [1.0, 2.0, 3.0, 4.0]), (2, None), (3, [1.0, None, 3.0, 4.0]), (4, [float("nan")] * 4), (5, [float("inf")] * 4), (None, [0.0, -0.5, 0.25, 9.0]), (1, [1.0, 2.0, 3.0, 4.0])]
    docs = spark.createDataFrame([(*r, 1, "x") for r in [*rows, (6, [1.0])]], "vec_id long, embedding array<double>, code int, label string")
    got, books, _ = run(docs)
    assert (got, books) == brute(rows)
    assert run(docs.limit(0)) == ([], [], [])
    told = codes.with_label_error(codes.compress(docs, "vec_id", "label")[0]).collect()
    assert len(told) == 3 and {r.label_error for r in told} == {sum(r.error for r in told)}


def test_labels_of_null_are_one(spark):
    coded = spark.createDataFrame([(1, None, 2), (2, None, 3), (3, 7, 4)], "vec_id long, label int, error long")
    assert {r.vec_id: r.label_error for r in codes.with_label_error(coded).collect()} == {1: 5, 2: 5, 3: 4}


def test_large_numbers_are_exact():
    x, c = np.array([[2**29, -(2**29)], [2**29 - 1, 7]]), np.array([[-(2**28), 3], [2**29, 5]])
    assert codes.squared(x, c).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, e, strict=True)) for e in c] for r in x]


def test_decompress(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    coded, books, _ = codes.compress(docs, "vec_id")
    back = {r.vec_id: np.array(r.embedding) for r in codes.decompress(coded, books).collect()}
    for r in coded.join(docs, "vec_id").collect():
        x = np.floor(np.array(r.embedding) * 1024)
        assert ((x - back[r.vec_id] * 1024) ** 2).sum() == r.error


def test_embeddings(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/embeddings.parquet")
    want, books = brute([(r.vec_id, r.embedding) for r in docs.collect()])
    rows = registry.op11_vector_codes(spark, sf).collect()
    assert sorted((r.vec_id, r.code, r.error) for r in rows) == sorted((i, "".join(f"{k:02x}" for k in c), e) for i, c, e in want)
    assert {r.codebooks_sha256 for r in rows} == {hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()}


def test_hex(spark):
    assert spark.range(1).select(codes.hex_code(F.array(F.lit(0), F.lit(10), F.lit(255), F.lit(16)))).first()[0] == "000aff10"
