"""Overlap of small bit masks under shifts: the references that a query's mask fits best.

A mask is a square of size * size bits, row by row.  Two masks overlap by the greatest ratio of shared to joint bits over
all shifts of the second one by up to `shift` places in both directions; what is shifted out of the square is lost.  Rows
are packed into 64-bit words, as many to a word as fit, so a shift is a shift of words and a count a popcount.  References
are dealt into shards and queries into blocks, each pair of them is one group that returns k rows a query.

In a group every query has k references from the first ones met; a mask of n bits can reach the kth of them only with so
many shared bits, and no more can be shared than the smaller mask has.  So references lie by their bits under each shift,
queries for which a count leaves no room pass over all of that count, and of the rest only the shared bits are counted.

Cases: null masks and masks of another length take no part; two empty masks overlap by 0; ties go to the smaller key; a
query isn't its own reference; rows of one key are one query and one reference, by the best of their masks.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.sources.shared import through_table

#: References of a shard, queries of a block (expected); references whose whole ratios are told first; masks compared at
#: once (queries, references); partitions of the groups at most.
SHARD, BLOCK, FIRST, ROWS, COLUMNS, TASKS = 131_072, 2048, 256, 16, 4096, 4096
NONE = np.iinfo(np.int64).max


def packed(bits: np.ndarray, size: int) -> np.ndarray:
    """Masks as rows of words: bit x of word y is the mask's bit in row y, column x."""
    return (bits.reshape(-1, size, size).astype(np.uint64) << np.arange(size, dtype=np.uint64)).sum(2, dtype=np.uint64)


def dense(words: np.ndarray) -> np.ndarray:
    """Rows of words with as many rows in a word as fit."""
    size = words.shape[1]
    fit = 64 // size
    out = np.zeros((len(words), -(-size // fit)), np.uint64)
    for y in range(size):
        out[:, y // fit] |= words[:, y] << np.uint64(y % fit * size)
    return out


def opened(words: np.ndarray, size: int) -> np.ndarray:
    """`dense` undone: a word for each row."""
    fit, inside = 64 // size, np.uint64((1 << size) - 1)
    return np.stack([words[:, y // fit] >> np.uint64(y % fit * size) & inside for y in range(size)], 1)


def shifted(words: np.ndarray, down: int, right: int) -> np.ndarray:
    """The masks moved down and to the right (or, negative, up and to the left)."""
    size = words.shape[1]
    out = np.zeros_like(words)
    out[:, max(0, down) : size + min(0, down)] = words[:, max(0, -down) : size - max(0, down)]
    inside = np.uint64((1 << size) - 1)
    return (out << np.uint64(right)) & inside if right >= 0 else out >> np.uint64(-right)


def moves(shift: int) -> list[tuple[int, int]]:
    """All shifts, those that lose least first."""
    return sorted(product(range(-shift, shift + 1), repeat=2), key=lambda m: (abs(m[0]) + abs(m[1]), m))


def held(words: np.ndarray) -> np.ndarray:
    """The bits of each mask."""
    return np.bitwise_count(words).sum(1, dtype=np.int64)


def shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The bits that each mask of a shares with each of b (dense)."""
    both = np.bitwise_count(a[:, 0, None] & b[None, :, 0])
    for w in range(1, a.shape[1]):
        both = np.add(both, np.bitwise_count(a[:, w, None] & b[None, :, w]), dtype=np.uint16)
    return both


def overlaps(queries: np.ndarray, references: np.ndarray, shift: int) -> np.ndarray:
    """The best ratio for each query and reference (packed)."""
    mine, bits = dense(queries), held(queries)
    best = np.zeros((len(queries), len(references)))
    for down, right in moves(shift):
        moved = dense(shifted(references, down, right))
        both = shared(mine, moved)
        either = bits[:, None] + held(moved)[None, :] - both
        best = np.maximum(best, np.divide(both, either, out=np.zeros_like(best), where=either > 0))
    return best


def _joined(best: tuple[np.ndarray, np.ndarray], at: np.ndarray, names: np.ndarray, scores: np.ndarray) -> None:
    """Puts finds (the query's place, the reference, its score) among each query's k best, in place: a reference once."""
    k, touched = best[0].shape[1], np.unique(at)
    at = np.concatenate([np.repeat(touched, k), at])
    names, scores = np.concatenate([best[0][touched].ravel(), names]), np.concatenate([best[1][touched].ravel(), scores])
    order = np.lexsort((-scores, names, at))
    at, names, scores = at[order], names[order], scores[order]
    once = np.r_[True, (at[1:] != at[:-1]) | (names[1:] != names[:-1])]
    at, names, scores = at[once], names[once], scores[once]
    order = np.lexsort((names, -scores, at))
    at, names, scores = at[order], names[order], scores[order]
    rank = np.arange(len(at)) - np.searchsorted(at, at)
    best[0][touched], best[1][touched] = NONE, -1.0
    top = rank < k
    best[0][at[top], rank[top]], best[1][at[top], rank[top]] = names[top], scores[top]


def nearest(queries: np.ndarray, asking: np.ndarray, references: np.ndarray, names: np.ndarray, shift: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query (packed, with its key) the k references of the best ratios: keys and ratios, best first; NONE and -1 where there are fewer."""
    order = np.argsort(names, kind="stable")
    references, names = references[order], names[order]
    best = np.full((len(queries), k), NONE), np.full((len(queries), k), -1.0)
    keys = np.unique(names)
    first = np.searchsorted(names, keys[: FIRST + k + 1][-1], "right")  # k smaller keys for all that share no bit
    for a, b in product(range(0, len(queries), FIRST), range(0, first, FIRST)):
        score = overlaps(queries[a : a + FIRST], references[b : min(first, b + FIRST)], shift)
        i, j = np.nonzero(asking[a : a + FIRST, None] != names[None, b : min(first, b + FIRST)])
        _joined(best, a + i, names[b + j], score[i, j])
    references, names = references[first:], names[first:]
    mine, bits = dense(queries), held(queries)
    for down, right in moves(shift) if len(names) else ():
        moved = dense(shifted(references, down, right))
        count = held(moved)
        order = np.argsort(count, kind="stable")
        moved, named = moved[order], names[order]
        ends = np.searchsorted(count[order], np.arange(count.max() + 2))
        for n in sorted(np.flatnonzero(np.diff(ends)), key=lambda n: abs(n - np.median(bits))):
            least = best[1][:, -1]
            need = np.maximum(1, np.ceil(least * (bits + n) / (1 + least) - 1e-6)).astype(np.int64)  # exact: other sums are 1 / 8192 away at least
            room = np.flatnonzero(need <= np.minimum(bits, n))
            finds = []
            for a, b in product(range(0, len(room), ROWS), range(ends[n], ends[n + 1], COLUMNS)):
                rows, columns = room[a : a + ROWS], slice(b, min(ends[n + 1], b + COLUMNS))
                both = shared(mine[rows], moved[columns])
                enough = both >= need[rows, None].astype(both.dtype)
                if enough.any():
                    i, j = np.nonzero(enough)
                    both, at, name = both[i, j].astype(np.int64), rows[i], named[columns][j]
                    score = both / (bits[at] + n - both)
                    better = (name != asking[at]) & ((score > least[at]) | (score == least[at]) & (name < best[0][at, -1]))
                    finds.append((at[better], name[better], score[better]))
            if any(len(f[0]) for f in finds):
                _joined(best, *map(np.concatenate, zip(*finds, strict=True)))
    return best


def best_overlaps(masks: DataFrame, is_query: Column, key: str, mask: str, size: int, shift: int = 4, k: int = 2) -> DataFrame:
    """(query, ref, score, rank) of each query row's k references of greatest overlap. mask: array of size * size booleans; size is 64 at most."""
    usable = masks.filter(F.col(key).isNotNull() & (F.size(mask) == size * size) & ~F.exists(mask, lambda b: b.isNull()))

    def pack(batches):
        for batch in batches:
            words = dense(packed(batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(bool), size))
            m = pa.array([w.tobytes() for w in words], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), m, batch.column(2)], names=["k", "m", "q"])

    rows = usable.select(F.col(key).cast("long").alias("k"), F.col(mask).cast("array<boolean>").alias("m"), F.coalesce(is_query, F.lit(False)).alias("q"))
    x = through_table(rows.mapInArrow(pack, "k long, m binary, q boolean"), "masks")
    n, asked = x.agg(F.count("*"), F.count_if("q")).first()
    shards, blocks = max(1, -(-n // SHARD)), max(1, -(-asked // BLOCK))
    words = lambda t: opened(np.frombuffer(b"".join(t.column("m").to_pylist()), np.uint64).reshape(t.num_rows, -1), size)

    def best(keys: tuple, refs: pa.Table, queries: pa.Table) -> pa.Table:
        found = np.empty((0, k), np.int64), np.empty((0, k))
        asking = queries.column("k").to_numpy()
        if refs.num_rows and queries.num_rows:
            found = nearest(words(queries), asking, words(refs), refs.column("k").to_numpy(), shift, k)
        i, j = np.nonzero(found[1] >= 0)
        return pa.table({"query": pa.array(asking[i], pa.int64()), "ref": pa.array(found[0][i, j], pa.int64()), "score": pa.array(np.round(found[1][i, j], 9), pa.float64())})

    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    dealt = lambda t: t.repartition(min(TASKS, shards * blocks), "s", "b").groupBy("s", "b")
    refs = x.select("k", "m", F.pmod(F.xxhash64(F.lit(1), "k"), F.lit(shards)).alias("s"), every(blocks).alias("b"))
    queries = x.filter("q").select("k", "m", every(shards).alias("s"), F.pmod(F.xxhash64(F.lit(2), "k"), F.lit(blocks)).alias("b"))
    found = dealt(refs).cogroup(dealt(queries)).applyInArrow(best, "query long, ref long, score double")
    w = Window.partitionBy("query").orderBy(F.desc("score"), "ref")
    return found.groupBy("query", "ref").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def classified(best: DataFrame, least: float = 0.93, margin: float = 0.03) -> DataFrame:
    """From the two best of each query: query, ref, score, margin over the runner-up (0 if there is none), and status:
    accepted with a score of least and a margin, else review."""
    top = best.groupBy("query").agg(F.max(F.when(F.col("rank") == 1, F.col("ref"))).alias("ref"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("score"), F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("score"))), F.lit(0.0)).alias("second"))
    apart = F.round(F.col("score") - F.col("second"), 9)
    return top.select("query", "ref", "score", apart.alias("margin"), F.when((F.col("score") >= least) & (apart >= margin), "accepted").otherwise("review").alias("status"))
