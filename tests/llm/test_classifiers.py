import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import langid, quality

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def test_quality_held_out(docs, labels):
    got = quality.classify(docs, labels)
    rows = {r.doc_id: r for r in got.collect()}
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for d, r in rows.items())
    truth = [(x.quality, rows[x.doc_id].predicted) for x in labels.collect() if rows[x.doc_id].held_out]
    assert np.mean([a == b for a, b in truth]) > 0.95
    assert np.mean([b == 1 for a, b in truth if a == 1]) > 0.97


def test_quality_odd_rows(spark, labels):
    docs = spark.createDataFrame([(1, None, 0.1), (2, "", 0.1), (3, "fine words here", 0.1), (3, "fine words here", 0.1), (None, "x" * 200_000, None)], "doc_id long, text string, score double")
    got = quality.classify(docs, labels).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.score)
    assert by[1] == by[2] and len(by[3]) == 1
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_risk_is_not_negative_and_separates():
    rng = np.random.default_rng(3)
    p = rng.normal(1, 0.5, (400, 5)).astype(np.float32)
    u = np.vstack([rng.normal(1, 0.5, (600, 5)), rng.normal(-1, 0.5, (200, 5))]).astype(np.float32)
    m = quality.nn_pu(p, u, 0.75)
    score = m.score(u)
    assert (score[:600] >= 0.5).mean() > 0.97 and (score[600:] < 0.5).mean() > 0.97


def test_language_held_out(docs):
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    n, right, far = got.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.sum(F.col("rejected").cast("int"))).first()
    assert right / n > 0.97 and far / n < 0.01


def test_language_odd_rows(spark, docs):
    odd = spark.createDataFrame([(1, None, "en"), (2, "", None), (3, "12 34 !!", "de"), (4, "Der die das und nicht", "de")], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    got = {r.doc_id: r for r in langid.predict(odd, model).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and all(got[k].rejected and got[k].score == 0 for k in (1, 2, 3))
    assert got[4].lang_pred == "de" and got[4].lang == "de"
    assert {r.lang_pred for r in langid.identify(odd.filter("lang is null")).collect()} == {"und"}
    assert langid.identify(docs.limit(0)).count() == 0


def test_foreign_texts_of_every_length_are_rejected(spark, docs):
    model = langid.fit(docs)
    assert (model.least > 0).all()
    rng, rows = np.random.default_rng(5), []
    for low, high in ((0x4E00, 0x9FA5), (0x430, 0x450), (0x3B1, 0x3CA)):
        for words in (4, 6, 30, 300, 1000, 5000, 20000):
            rows += [(words, " ".join("".join(map(chr, rng.integers(low, high, rng.integers(2, 8)))) for _ in range(words))) for _ in range(5)]
    got = langid.predict(spark.createDataFrame(rows, "words int, text string"), model).collect()
    assert all(r.rejected for r in got if r.words >= 30)
    assert np.mean([r.rejected for r in got if r.words < 30]) > 0.9
    short = docs.filter("length(text) > 100").select("doc_id", F.substring("text", 1, 25).alias("text"))
    long = docs.filter("length(text) > 100").groupBy("lang", F.expr("doc_id % 20").alias("doc_id")).agg(F.repeat(F.concat_ws(" ", F.array_sort(F.collect_list("text"))), 3).alias("text"))
    for genuine in (short, long):
        assert langid.predict(genuine, model).agg(F.avg(F.col("rejected").cast("int"))).first()[0] < 0.02


def test_features_equal_brute_force():
    texts = ["One two, two three!\nOne two, two three!\nx", "", "ab", "Étude 12.5 % \t(note)\r\nend " + "longwordoverTwentyletters " * 3]
    raw = [t.encode() for t in texts]
    got = quality.features(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    kinds = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".", ",", "!?", "'\"-:;()"]
    for text, bytes_, row in zip(texts, raw, got, strict=True):
        c = [next((k for k, s in enumerate(kinds) if chr(b) in s), 10 if b > 127 else 11 if b < 32 or b == 127 else 9) for b in bytes_]
        want = np.zeros(quality.WIDTH)
        for x, y, z in zip(c, c[1:], c[2:]):
            want[x * 144 + y * 12 + z] += 1
        want[:1728] = np.sqrt(want[:1728] / max(1, len(c) - 2))
        words, lines = bytes_.split(), [x for x in bytes_.replace(b"\r", b"\n").split(b"\n") if x]
        if words:
            n = [len(w) for w in words]
            pairs = [a == b for a, b in zip(words, words[1:])]
            want[1728:] = (np.mean(pairs) if pairs else 0, np.log2(len(words)) / 10, len(set(words)) / len(words) ** 0.9, np.mean(n) / 10, np.std(n) / 10, len(set(lines)) / len(lines), np.log2(1 + len(words) / len(lines)) / 10, np.mean([k > 20 for k in n]))
        assert np.allclose(row, want, atol=1e-5), text


def test_risk_equals_its_definition_and_is_at_a_minimum():
    rng = np.random.default_rng(7)
    p, u = rng.normal(0.7, 1, (300, 3)).astype(np.float32), np.vstack([rng.normal(0.7, 1, (200, 3)), rng.normal(-0.7, 1, (300, 3))]).astype(np.float32)
    prior = 0.4

    def risk(w, b):
        loss = lambda z: np.log1p(np.exp(-z))
        gp, gu = p @ w + b, u @ w + b
        return prior * loss(gp).mean() + max(0.0, loss(-gu).mean() - prior * loss(-gp).mean()) + quality.DECAY / 2 * (w * w).sum()

    m = quality.nn_pu(p, u, prior, steps=800)
    here = risk(m.weights, m.bias)
    assert all(here <= risk(m.weights + rng.normal(0, 0.15, 3), m.bias + rng.normal(0, 0.15)) + 1e-4 for _ in range(200))


@pytest.mark.parametrize("share", [0.2, 0.5, 0.8])
def test_prior_without_negatives(share):
    rng = np.random.default_rng(9)
    n = int(3000 * share)
    p = rng.normal(1.2, 1, (1500, 4)).astype(np.float32)
    u = np.vstack([rng.normal(1.2, 1, (n, 4)), rng.normal(-1.2, 1, (3000 - n, 4))]).astype(np.float32)
    rng.shuffle(u)
    assert abs(quality.learn(p, u).prior - share) < 0.06


def test_language_equals_brute_force(docs):
    model = langid.fit(docs)
    some = [r for r in docs.orderBy("doc_id").limit(60).collect() if r.text]
    raw = [r.text.encode() for r in some]
    counts = np.vstack(list(langid.trigram_counts(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))))
    who, cosine, _ = model.predict(counts)
    for k, b in enumerate(raw):
        folded = bytes(c if c > 127 else ord(chr(c).lower()) if chr(c).isalpha() else 32 for c in b)
        v = np.zeros(langid.SIZE)
        for x, y, z in zip(folded, folded[1:], folded[2:]):
            if (x, y) != (32, 32):
                v[((x * 0x9E3779B1 + y * 0x85EBCA77 + z * 0xC2B2AE3D) % 2**32) >> 20] += 1
        v = np.log1p(v) * model.idf
        cos = [float(v @ c) / np.linalg.norm(v) for c in model.centroids]
        assert model.owner[int(np.argmax(cos))] == who[k] and abs(max(cos) - cosine[k]) < 1e-4


def test_samples_are_bounded_whatever_is_repeated(spark):
    from marlstone.llm.runtime import bounded_sample

    rows = spark.range(4000).select((F.col("id") % 2).cast("string").alias("lang"), F.when(F.col("id") < 2000, F.lit("same")).otherwise(F.col("id").cast("string")).alias("text"))
    got = bounded_sample(rows, ["lang"], [F.col("text")], 50).groupBy("lang").count().collect()
    assert sorted((r["lang"], r["count"]) for r in got) == [("0", 50), ("1", 50)]
    assert bounded_sample(rows, [], [F.col("text")], 30).count() == 30
    assert bounded_sample(rows.limit(0), [], [F.col("text")], 30).count() == 0
