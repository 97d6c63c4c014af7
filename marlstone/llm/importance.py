"""Importance resampling towards a target: hashed n-gram buckets, bit-sliced exact weights, a Gumbel draw.

Features are all runs of low to high consecutive words of the lower-cased text, repeats counted; a feature's bucket is
its crc32 modulo BUCKETS.  A bucket's gain is the scaled log ratio of its smoothed share in the target to that in the
source, floored; a document's weight is the floored mean gain of its features.  The mean is taken bit-sliced: the bits
of a document's bucket counts are planes of BUCKETS bits, the bits of the positive and of the negative gains are planes
too, and the sum of count times gain is the popcount of every pair of planes, times a power of two: integers, so exact.
The draw adds a Gumbel number made from the id's sha256, so that the best scores are a sample without replacement.

Texts are read once for the counts, which are written as sparse lists; gains are BUCKETS numbers.

Cases: a null or wordless text has no features and weight 0; a row with a null id has no score and is neither drawn nor
counted among those the share is taken of; repeated rows are separate documents (the share counts each), ranked one
after the other; ties go to smaller ids, then to fewer features; an empty table gives no rows, and an empty target gives gains that
only tell rare buckets from common ones; columns of other names are left alone.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.runtime import ship_package, through_table
from marlstone.llm.textbatch import batches_of, lower_ascii, spans, utf8
from marlstone.operators.ranking import numbered

#: Buckets, and the words of a document that may be drawn.
BUCKETS, LEAST_WORDS = 10_000, 20
#: Words of more bytes than this are hashed one by one; documents whose planes are held together.
LONG, BLOCK = 48, 512

INSIDE = np.zeros(256, bool)
INSIDE[48:58] = INSIDE[97:123] = INSIDE[128:] = True


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_TABLE = _crc_table()


def crc32_on(crc: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each k the crc32 of what gave crc[k], followed by data[starts[k]:ends[k]]."""
    state, size = ~crc.astype(np.uint32), ends - starts
    short = np.flatnonzero(size <= LONG)
    short = short[np.argsort(-size[short], kind="stable")]  # the longest first: those with a byte at `at` lead
    left = np.searchsorted(-size[short], -np.arange(1, LONG + 1), side="right")
    s = state[short]
    for at, n in enumerate(left):
        if not n:
            break
        s[:n] = _TABLE[(s[:n] ^ data[starts[short[:n]] + at]) & 255] ^ (s[:n] >> np.uint32(8))
    out = np.empty(len(crc), np.uint32)
    out[short] = ~s
    for k in np.flatnonzero(size > LONG):
        out[k] = zlib.crc32(data[starts[k] : ends[k]].tobytes(), int(crc[k]))
    return out


def features(data: np.ndarray, offsets: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each feature of a batch of texts: the text's number and the crc32."""
    data = lower_ascii(data)
    starts, ends, first = spans(data, offsets, INSIDE)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    space = np.full(len(starts), 32, np.uint8)
    crc, texts, out = np.zeros(len(starts), np.uint32), [], []
    for n in range(1, high + 1):
        keep = len(starts) - n + 1
        if keep <= 0:
            break
        if n > 1:
            each = np.arange(keep)
            crc = crc32_on(crc[:keep], space[:keep], each, each + 1)
        crc = crc32_on(crc[:keep], data, starts[n - 1 :], ends[n - 1 :])
        if n >= low:
            whole = text[:keep] == text[n - 1 :]
            texts.append(text[:keep][whole])
            out.append(crc[whole])
    return (np.concatenate(texts), np.concatenate(out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.uint32))


def _lists(values: np.ndarray, sizes: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, kind))


def bucket_counts(docs: DataFrame, low: int = 1, high: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """id (`docs.doc_id`), n_words and n_features (long), and the sparse counts: bucket and times (array<int>), for (doc_id, text)."""
    ship_package(docs.sparkSession)

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for at, data, offsets in batches_of(utf8(batch.column(1))):
                n = len(offsets) - 1
                words = np.diff(spans(lower_ascii(data), offsets, INSIDE)[2])
                text, crc = features(data, offsets, low, high)
                cell, times = np.unique(text * buckets + crc % buckets, return_counts=True)
                of = np.bincount(cell // buckets, minlength=n)
                columns = [ids.slice(at, n), pa.array(words, pa.int64()), pa.array(np.bincount(text, minlength=n), pa.int64()), _lists(cell % buckets, of, pa.int32()), _lists(times, of, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n_words", "n_features", "bucket", "times"])

    return docs.select("doc_id", "text").mapInArrow(run, f"id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_features long, bucket array<int>, times array<int>")


def totals(counts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The features of each bucket in a whole table of counts; `buckets` rows come to the driver."""
    out = np.zeros(buckets, np.int64)
    for r in counts.select(F.inline(F.arrays_zip("bucket", "times"))).groupBy("bucket").agg(F.sum("times").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray, scale: int = 1000) -> np.ndarray:
    """floor(scale * ln(ratio of the smoothed share in the target to that in the source)), in doubles, for each bucket."""
    n, s, t = float(len(source)), source.astype(np.float64), target.astype(np.float64)
    return np.floor(scale * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    wide = np.zeros((len(bits), -(-bits.shape[1] // 64) * 64), bool)
    wide[:, : bits.shape[1]] = bits
    return np.packbits(wide, axis=1, bitorder="little").view(np.uint64)


def planes(values: np.ndarray) -> list[np.ndarray]:
    """The bits of a row of numbers that aren't negative: a row of bits for each power of two."""
    return [_packed(((values >> j) & 1).astype(bool)[None, :])[0] for j in range(int(values.max(initial=0)).bit_length())]


def sums(row: np.ndarray, bucket: np.ndarray, times: np.ndarray, n: int, up: list[np.ndarray], down: list[np.ndarray], buckets: int) -> np.ndarray:
    """For each of n documents the sum of times * gain, from (row, bucket, times) and the gains' positive and negative planes."""
    out = np.zeros(n, np.int64)
    for i in range(int(times.max(initial=0)).bit_length()):
        has = np.flatnonzero((times >> i) & 1)
        rows, place = np.unique(row[has], return_inverse=True)
        bits = np.zeros((len(rows), buckets), bool)
        bits[place, bucket[has]] = True
        mine = _packed(bits)
        for sign, gain in ((1, up), (-1, down)):
            for j, plane in enumerate(gain):
                out[rows] += sign * (np.bitwise_count(mine & plane).sum(1, dtype=np.int64) << (i + j))
    return out


def weights(counts: DataFrame, gain: np.ndarray, buckets: int = BUCKETS) -> DataFrame:
    """id, n_words, n_features and weight (long), from the sparse counts and the gains."""
    up, down = planes(np.maximum(gain, 0)), planes(np.maximum(-gain, 0))

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                listed, n = batch.column(3), batch.num_rows
                row = np.repeat(np.arange(n), pa.compute.list_value_length(listed).to_numpy(zero_copy_only=False))
                total = sums(row, listed.flatten().to_numpy(), batch.column(4).flatten().to_numpy(), n, up, down, buckets)
                of = batch.column(2).to_numpy()
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.where(of > 0, total // np.maximum(of, 1), 0), pa.int64())], names=["id", "n_words", "n_features", "weight"])

    kind = counts.schema["id"].dataType.simpleString()
    return counts.select("id", "n_words", "n_features", "bucket", "times").mapInArrow(run, f"id {kind}, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, per_cent: int = 10, seed: int = 2024, low: int = 1, high: int = 1, least_words: int = LEAST_WORDS, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of `docs` (doc_id, text): rank is null for what isn't drawn.

    `target` has a column text; per_cent of the documents of least_words words or more are drawn."""
    counts = through_table(bucket_counts(docs, low, high, buckets), "bucket-counts")
    wanted = bucket_counts(target.select(F.lit(0).alias("doc_id"), "text"), low, high, buckets)
    weighed = weights(counts, gains(totals(counts, buckets), totals(wanted, buckets)), buckets)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    may = F.col("id").isNotNull() & (F.col("n_words") >= least_words)
    scored = weighed.select("id", "n_features", "weight", (F.col("weight") + noise).alias("score"), may.alias("may"))
    placed = numbered(scored, [], [F.desc("may"), F.desc_nulls_last("score"), F.asc_nulls_last("id"), F.asc("n_features")], "place")
    drawn = counts.filter(may).count() * per_cent // 100
    rank = F.when(F.col("may") & (F.col("place") <= drawn), F.col("place"))
    return placed.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", rank.alias("rank"))


def drawn(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn rows of `docs` with all their columns: what a training run reads.  Rows of one id are drawn together."""
    ids = resample(docs, target, **options).filter("rank IS NOT NULL").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(ids, docs["doc_id"] == ids["_drawn"], "left_semi")
