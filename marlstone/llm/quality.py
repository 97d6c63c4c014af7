"""A quality classifier from positive and unlabelled text: non-negative unbiased risk with an estimated class prior.

A linear scorer over the shape of a whole text: square roots of the frequencies of byte-class trigrams, and a few ratios
of words and lines (repeats, lengths, distinctness).  It minimises, by full-batch Adam with the logistic loss l,
    prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)])
with trusted positives P (labels.quality 1), a bounded hash sample of the labelled rows, and all unlabelled rows U; where
the second part is negative its gradient is reversed.  U is dealt by hash into groups of about UNLABELLED rows, each group
is fitted against P in a task of its own, and the scorers and priors are averaged by the groups' sizes: every row
counts, and no task holds more than a group.  No negative label is ever read: the prior is estimated from P and U alone,
by best-bin estimation.  A scorer of P against U is fitted on half of each; on the other halves, the prior is
the least ratio of the shares of U and P over a score, at the score where that ratio's upper confidence bound is least.
The driver holds P's features and a scorer for each group, summed in Spark.

Cases: a null text scores as an empty one; an id that is also labelled other than 1 isn't a trusted positive; with no
positives or no rows to learn from, every score is 0.5.  Repeated rows score alike, and are learnt from once.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType

from marlstone.llm.runtime import bounded_sample, held_out, ship_package, with_fields
from marlstone.llm.textbatch import batches_of, span_hashes, spans, utf8

#: Labelled rows at most that the classifier is fitted on, and unlabelled rows in a group (about).
POSITIVES, UNLABELLED = 2000, 2000
#: Confidence of the prior's bounds, and how much of them the least ratio is charged.
DELTA, CHARGE = 0.1, 1.01
STEPS, RATE, DECAY = 250, 0.03, 1e-3

#: Byte classes: lower case, upper case, digit, space, line end, full stop, comma, ! and ?, other ASCII marks in prose,
#: rare ASCII symbols, bytes over 127, control bytes.
CLASSES = 12
_CLASS = np.full(256, 9, np.uint16)
for _k, _bytes in enumerate((range(97, 123), range(65, 91), range(48, 58), b" \t", b"\n\r", b".", b",", b"!?", b"'\"-:;()", b"", range(128, 256), [*range(9), *range(14, 32), 127])):
    _CLASS[list(_bytes)] = _k
_WORD = np.ones(256, bool)
_WORD[[32, *range(9, 14)]] = False
_LINE = np.ones(256, bool)
_LINE[[10, 13]] = False
RATIOS = 8
WIDTH = CLASSES**3 + RATIOS


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of WIDTH numbers for each text."""
    n = len(offsets) - 1
    c = _CLASS[data]
    grams = c[:-2] * np.uint16(CLASSES * CLASSES) + c[1:-1] * np.uint16(CLASSES) + c[2:] if len(c) > 2 else np.zeros(0, np.uint16)
    out = np.zeros((n, WIDTH), np.float32)
    ws, we, wb = spans(data, offsets, _WORD)
    ls, le, lb = spans(data, offsets, _LINE)
    wh, lh = span_hashes(data, ws, we), span_hashes(data, ls, le)
    for k in range(n):
        s, e = offsets[k], offsets[k + 1]
        if e - s > 2:
            out[k, :-RATIOS] = np.sqrt(np.bincount(grams[s : e - 2], minlength=CLASSES**3) / (e - s - 2))
        words, lines = wh[wb[k] : wb[k + 1]], lh[lb[k] : lb[k + 1]]
        if len(words):
            lengths = (we - ws)[wb[k] : wb[k + 1]]
            out[k, -RATIOS:] = (
                (words[1:] == words[:-1]).mean() if len(words) > 1 else 0,
                np.log2(len(words)) / 10,
                len(np.unique(words)) / len(words) ** 0.9,
                lengths.mean() / 10,
                lengths.std() / 10,
                len(np.unique(lines)) / len(lines),
                np.log2(1 + len(words) / len(lines)) / 10,
                (lengths > 20).mean(),
            )
    return out


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x.astype(np.float64) @ self.weights + self.bias, -30, 30)))


def nn_pu(p: np.ndarray, u: np.ndarray, prior: float | None, steps: int = STEPS) -> Model:
    """Minimises the non-negative risk of scaled rows; without a prior the plain logistic risk of P against U."""
    start = 0.5 if prior is None else prior
    w, b = np.zeros(p.shape[1], np.float32), np.float32(np.log(start / (1 - start)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, steps + 1):
        gp, gu = p @ w + b, u @ w + b
        if prior is None:
            from_p, rest_p, rest_u = -0.5 * sigmoid(-gp) / len(p), 0, 0.5 * sigmoid(gu) / len(u)
        else:
            negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
            from_p = -prior * sigmoid(-gp) / len(p)  # of prior * E_P[l(g)]
            rest_p, rest_u = -prior * sigmoid(gp) / len(p), sigmoid(gu) / len(u)  # of E_U[l(-g)] - prior * E_P[l(-g)]
            if negative < 0:
                from_p, rest_p, rest_u = 0 * from_p, -rest_p, -rest_u
        grad, grad_b = p.T @ (from_p + rest_p) + u.T @ rest_u + DECAY * w, (from_p + rest_p).sum() + rest_u.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2, 0.9 * mb + 0.1 * grad_b, 0.99 * vb + 0.01 * grad_b**2
        rate = RATE * min(1.0, 2 * (1 - t / (steps + 1))) / (1 - 0.9**t)
        w = w - (rate * m / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
        b = np.float32(b - rate * mb / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8))
    return Model(w.astype(np.float64), float(b), start)


def best_bin(p: np.ndarray, u: np.ndarray) -> float:
    """The share of positives in u from scores of positives and of unlabelled rows that no scorer was fitted on."""
    cuts = np.sort(p)[::-1]
    of_p = np.arange(1, len(p) + 1) / len(p)
    of_u = (len(u) - np.searchsorted(np.sort(u), cuts)) / len(u)
    doubt = np.sqrt(np.log(4 / DELTA) / (2 * len(p))) + np.sqrt(np.log(4 / DELTA) / (2 * len(u)))
    best = int((of_u / of_p + CHARGE * doubt / of_p).argmin())
    return float(np.clip(of_u[best] / of_p[best], 0.02, 0.98))


def learn(p: np.ndarray, u: np.ndarray) -> Model:
    """The prior, then the classifier, from features of positive and unlabelled rows (which are changed)."""
    if not len(p) or not len(u):
        return Model(np.zeros(WIDTH), 0.0, 0.5)
    centre = u.mean(0)
    u -= centre
    p -= centre
    spread = np.sqrt(np.einsum("ij,ij->j", u, u) / len(u))
    scale = np.where(spread > 1e-6, 1 / (spread + 0.01), 0).astype(np.float32)
    u *= scale
    p *= scale
    prior = 0.5
    if len(p) > 1 and len(u) > 1:
        halves = nn_pu(p[::2], u[::2], None)
        prior = best_bin(halves.score(p[1::2]), halves.score(u[1::2]))
    model = nn_pu(p, u, prior)
    weights = model.weights * scale
    return Model(weights, float(model.bias - centre @ weights), prior)


def _features(batches):
    for batch in batches:
        for at, data, offsets in batches_of(utf8(batch.column(1)), rows=512):
            x = features(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(x)), pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary())], names=["part", "x"])


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    rows = sorted(column.to_pylist(), key=lambda r: (zlib.crc32(r), r))  # the rows come in no order
    return np.frombuffer(b"".join(rows), np.float16).reshape(-1, WIDTH).astype(np.float32)


def _learnt(positives):
    """Of one group of unlabelled rows: its scorer and prior against the positives, each times its rows."""

    def run(rows: pa.Table) -> pa.Table:
        u = _matrix(rows.column("x"))
        model, n = learn(positives.value.astype(np.float32), u), rows.num_rows
        return pa.table({"n": [n], "weights": [(n * model.weights).tolist()], "bias": [n * model.bias], "prior": [n * model.prior]})

    return run


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """Learns from documents whose ids aren't held out, and from which of them are labelled 1."""
    spark = docs.sparkSession
    ship_package(spark)
    by_id = labels.filter(~held_out() & F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("lo"), F.max("quality").alias("hi"))
    chosen = bounded_sample(by_id.filter("lo = 1 AND hi = 1").select("doc_id"), [], [F.col("doc_id")], positives)  # positives rows at most
    learnable = docs.filter(~held_out()).select("doc_id", F.col("text").cast("string").alias("text"))
    # An id may have many rows; of those one text is taken.
    p = bounded_sample(learnable.join(F.broadcast(chosen), "doc_id", "left_semi"), [], [F.col("doc_id")], positives)
    known = p.select(F.lit(0).cast("long").alias("part"), "text").mapInArrow(_features, "part long, x binary").select("x").toArrow()  # positives rows at most
    n = learnable.count()
    if not known.num_rows or not n:
        return Model(np.zeros(WIDTH), 0.0, 0.5)
    shared = spark.sparkContext.broadcast(_matrix(known.column("x")).astype(np.float16))
    once = learnable.groupBy("doc_id", F.xxhash64("text").alias("h")).agg(F.min("text").alias("text"))
    dealt = once.select(F.pmod(F.xxhash64(F.lit(11), "doc_id", "h"), F.lit(-(-n // unlabelled))).alias("part"), "text").mapInArrow(_features, "part long, x binary")
    each = dealt.groupBy("part").applyInArrow(_learnt(shared), "n long, weights array<double>, bias double, prior double")
    whole = each.select("n", "bias", "prior", F.posexplode("weights").alias("k", "w")).groupBy("k").agg((F.sum("w") / F.sum("n")).alias("w"), (F.sum("bias") / F.sum("n")).alias("bias"), (F.sum("prior") / F.sum("n")).alias("prior"))
    got = sorted(whole.collect(), key=lambda r: r["k"])  # WIDTH rows
    return Model(np.array([r["w"] for r in got]), got[0]["bias"], got[0]["prior"])


def predict(docs: DataFrame, model: Model, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """All columns of `docs`, score (0 to 1, higher is better) and predicted (1 from 0.5 on), called as `names` says;
    older columns of these names are replaced."""
    ship_package(docs.sparkSession)
    docs = docs.drop(*names)
    kept = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for first, data, offsets in batches_of(utf8(batch.column(kept.index("text"))), rows=512):
                score = shared.value.score(features(data, offsets))
                part = batch.slice(first, len(score))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[*kept, *names])

    return docs.mapInArrow(run, with_fields(docs, **dict(zip(names, (DoubleType(), IntegerType()), strict=True))))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every whole text."""
    return predict(docs.select("doc_id", "text"), fit(docs, labels)).select("doc_id", held_out().alias("held_out"), "score", "predicted")
