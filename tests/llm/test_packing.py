import math
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marlstone.llm import packing

PATH = P.path("byte_bpe_50k.json")


def truth(text):
    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 2]


def test_pack(spark):
    rows = [(1, "Hello there", 1), (2, None, 2), (3, "", 3), (4, "the cat's hat \n\n é " * 700, 4), (5, "<|endoftext|>", 5), (1, "Hello there", 1), (None, "x y " * 40, 6)]
    docs = spark.createDataFrame(rows * 2, "doc_id long, text string, piece int")
    got = packing.pack(docs, PATH, P.PATTERN, added_tokens=True).collect()
    want = {d: truth(t) for d, t, _ in rows}
    by_doc: dict = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert set(by_doc) == set(want)
    for d, ids in want.items():
        copies = sum(2 for x in rows if x[0] == d)
        first = len(ids) % 1024 or 1024
        spans = [(0, 0, first)] + [(k + 1, a, 1024) for k, a in enumerate(range(first, len(ids), 1024))] if len(ids) > 1024 else [(0, 0, len(ids))]
        expected = sorted((k, a, n, zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes())) for k, a, n in spans for _ in range(copies))
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in by_doc[d]) == expected
    seqs: dict = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r.length for r in got)
    assert len(seqs) <= total / 1024 * 1.2 + 1
    assert packing.pack(docs.limit(0), PATH, P.PATTERN).count() == 0
    ids = packing.pieces(docs, PATH, P.PATTERN, keep_ids=True).filter("doc_id = 1").first().ids
    assert ids == want[1]


def brute_best_fit(lengths, capacity, weights, block):
    """One piece after the other, every sequence looked at."""
    sequences, out = [], []
    for n in lengths:
        size = (n, 1, math.ceil(n / block) ** 2)
        best = None
        for k, used in enumerate(sequences):
            left = [c - u - s for c, u, s in zip(capacity, used, size)]
            if min(left) >= 0:
                norm = sum(w * (x / c) ** 2 for w, x, c in zip(weights, left, capacity))
                if best is None or norm < best[0] - 1e-15:
                    best = (norm, k)
        if best is None:
            sequences.append([0, 0, 0])
            best = (0, len(sequences) - 1)
        k = best[1]
        out.append((k, sequences[k][0]))
        sequences[k] = [u + s for u, s in zip(sequences[k], size)]
    return out, sequences


@pytest.mark.parametrize("capacity,weights,block", [((100, 4, 60), (1.0, 0.3, 0.2), 10), ((1024, packing.MOST, 64), (1.0, 0.01, 0.05), 128), ((64, 64, 4), (1.0, 0.5, 0.5), 32)])
def test_equals_brute_force_best_fit(capacity, weights, block):
    rng = np.random.default_rng(5)
    lengths = np.sort(np.concatenate([rng.integers(1, capacity[0] + 1, 300), rng.integers(1, max(2, capacity[0] // 50), 900)]))[::-1]
    where, offset = packing.fit(lengths, capacity, weights, block)
    want, sequences = brute_best_fit(lengths.tolist(), capacity, weights, block)
    assert list(zip(where.tolist(), offset.tolist(), strict=True)) == want
    assert any(s[1] == capacity[1] or s[2] == capacity[2] for s in sequences if s[0] < capacity[0])  # another bound than tokens binds


def test_each_capacity_binds_alone(spark):
    """Short documents fill the pieces of a sequence, those of a block and a token its attention cost, long ones its tokens."""
    most = packing.MOST
    for size, n, held in ((3, 3 * most + 1, most), (129, 40, 7), (513, 9, 1)):
        where, _ = packing.fit(np.full(n, size), (1024, most, 64), (1.0, 0.01, 0.05))
        assert max(np.bincount(where)) == held and len(set(where)) == math.ceil(n / held)
    where, _ = packing.fit(np.full(20, 129), (1 << 20, 100, 64), (1.0, 0.01, 0.05))
    assert max(np.bincount(where)) == 16  # 16 * 2 * 2
    short = spark.range(2 * most + 1).select(F.col("id").alias("doc_id"), F.lit("a").alias("text"))
    per = [r["count"] for r in packing.pack(short, PATH, P.PATTERN).groupBy("sequence_id").count().collect()]
    assert sorted(per) == [1, most, most]


def test_repeated_rows_fill_several_shards(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 50)
    docs = spark.range(1000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("the same words " * 30).alias("text")).repartition(4)
    got = packing.pack(docs, PATH, P.PATTERN).collect()
    shards = {}
    for r in got:
        shards[r.sequence_id >> 32] = shards.get(r.sequence_id >> 32, 0) + 1
    assert len(got) == 1000 and len(shards) >= 15 and max(shards.values()) < 200


def test_queries_give_added_tokens_their_ids(spark, tmp_path):
    import corpus_pipeline
    from marlstone.llm import registry

    t = Tokenizer.from_file(PATH)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "  <|endoftext|>\n\n foo", "<|endoftext|><|endoftext|>x <|endoftext|", "é <|endoftext|> it's " * 400, "none", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for d, x in enumerate(texts):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4")
        ends = range(len(ids) % 1024 or min(1024, len(ids)), len(ids) + 1, 1024)
        want += [(d, k, int(e) - len(p), len(p), zlib.crc32(p.tobytes())) for k, (e, p) in enumerate((e, ids[max(0, e - 1024) : e]) for e in ends)]
    for got in (registry.op7_best_fit_packing(spark, str(tmp_path)), corpus_pipeline.sequences(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))):
        assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got.collect()) == want
