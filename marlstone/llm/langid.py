"""Language identification by nearest centroid: TF-IDF vectors of hashed letter trigrams against several centroids per language.

Document frequencies are counted over all rows that may be learnt from.  The centroids come from a bounded sample of
them (PER_LANGUAGE rows each, chosen by hash), in one task: spherical k-means within each language.  A text gets the language of the
centroid of greatest cosine.  Rejection is by distance: a cosine under what learnt texts of about that many trigrams
reach, or no letter at all.  Every length has a limit: where few learnt texts are that short, the beginnings of longer ones
stand in for them, and elsewhere those of the nearest lengths, shorter ones first (their cosines are smaller).

Cases: a null text or one without a letter is `und` with score 0 and rejected; ties go to the language that sorts first;
with nothing to learn from, every text is `und`.  Labels that are null or the empty string teach nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType

from marlstone.llm.runtime import bounded_sample, held_out, ship_package, with_fields
from marlstone.llm.textbatch import batches_of, utf8

#: Hashed trigrams; rows of each language that centroids are fitted on; centroids of each language.
SIZE, PER_LANGUAGE, CENTROIDS = 4096, 700, 4
#: Rows at most in the whole sample: with more languages than this allows, each has fewer.
SAMPLE = 35_000
#: A text is rejected under SLACK of the LOW quantile of the cosines of learnt texts of its length class, for
#: which LEAST_ROWS are gathered where there are as many; classes up to that of BEGINNING trigrams can be filled with beginnings.
SLACK, LOW, LEAST_ROWS, BEGINNING = 0.6, 0.01, 100, 255
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def trigrams(data: np.ndarray, offsets: np.ndarray):
    """For each text, the hashed trigrams of its letters (anything else is a space) in order; SIZE stands for none."""
    b = _FOLD[data].astype(np.uint32)
    if len(b) < 3:
        b = np.pad(b, (0, 3 - len(b)), constant_values=32)
    h = (b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(20)
    h[(b[:-2] == 32) & (b[1:-1] == 32)] = SIZE  # runs of spaces say nothing
    for s, e in zip(offsets[:-1], offsets[1:], strict=True):
        yield h[s : max(s, e - 2)]


def trigram_counts(data: np.ndarray, offsets: np.ndarray):
    """For each text, how often each hashed trigram occurs."""
    for h in trigrams(data, offsets):
        yield np.bincount(h, minlength=SIZE + 1)[:SIZE]


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts, dtype=np.float32) * idf
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, norm, out=v, where=norm > 0)


def _document_frequency(batches):
    found, n = np.zeros(SIZE, np.int64), 0
    for batch in batches:
        for _, data, offsets in batches_of(utf8(batch.column(0))):
            for c in trigram_counts(data, offsets):
                found += c > 0
                n += 1
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([*range(SIZE), -1], pa.int32()), pa.array([*found, n], pa.int64())], names=["gram", "df"])


def _sampled(batches):
    for batch in batches:
        for at, data, offsets in batches_of(utf8(batch.column(1)), rows=512):
            got = [np.minimum(c, 65535).astype("<u2").tobytes() for c in trigram_counts(data, offsets)]
            first = [h[h < SIZE][:BEGINNING].astype("<u2").tobytes() for h in trigrams(data, offsets)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(got)), pa.array(got, pa.binary()), pa.array(first, pa.binary())], names=["lang", "counts", "first"])


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k unit centroids (fewer rows: fewer), from the row nearest the mean and then the farthest rows on."""
    centre = x.mean(0)
    chosen = [int((x @ centre).argmax())]
    while len(chosen) < min(k, len(x)):
        chosen.append(int((x @ x[chosen].T).max(1).argmin()))
    c = x[chosen]
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        c = np.vstack([x[own == j].sum(0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


@dataclass
class Model:
    idf: np.ndarray
    languages: list[str]
    centroids: np.ndarray  # one row each
    owner: np.ndarray  # index into languages, of each centroid
    least: np.ndarray  # least accepted cosine by length class

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language index, cosine and whether the text is rejected."""
        cos = vectors(counts, self.idf) @ self.centroids.T
        at = cos.argmax(1)
        best = cos[np.arange(len(cos)), at]
        return self.owner[at], np.clip(best, 0, 1), best < self.least[length_class(counts)]


def length_class(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(counts.sum(1) + 1).astype(int), 15)


def fit(docs: DataFrame, learn: F.Column | None = None, per_language: int = PER_LANGUAGE) -> Model | None:
    """Learns from rows of `docs` (text, lang) where `learn` holds; None where there are none."""
    ship_package(docs.sparkSession)
    rows = docs.filter((F.lit(True) if learn is None else learn) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string"), F.col("text").cast("string"), F.col("doc_id"))
    df = rows.select("text").mapInArrow(_document_frequency, "gram int, df long").groupBy("gram").agg(F.sum("df").alias("df")).toArrow().to_pydict()
    if not df["gram"]:
        return None
    by = dict(zip(df["gram"], df["df"], strict=True))
    idf = np.log((1 + by[-1]) / (1 + np.array([by.get(k, 0) for k in range(SIZE)], np.float32))).astype(np.float32) + 0.1
    many = rows.select("lang").distinct().count()
    sample = bounded_sample(rows, ["lang"], [F.col("doc_id"), F.col("text")], max(1, min(per_language, SAMPLE // many)))
    got = sample.select("lang", "text").mapInArrow(_sampled, "lang string, counts binary, first binary").withColumn("all", F.lit(1))
    found = got.groupBy("all").applyInArrow(_learnt(idf), "languages array<string>, centroids binary, owner array<long>, least array<float>").first()
    if not found or not found.languages:
        return None
    return Model(idf, found.languages, np.frombuffer(found.centroids, np.float32).reshape(-1, SIZE), np.array(found.owner), np.array(found.least, np.float32))


def _learnt(idf: np.ndarray):
    """From the sample (SAMPLE rows at most, so one task) the model's languages, centroids and limits."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("lang", "ascending"), ("counts", "ascending"), ("first", "ascending")])
        counts = [np.frombuffer(c, "<u2") for c in rows.column("counts").to_pylist()]
        some = [k for k, c in enumerate(counts) if c.any()]
        lang, first = np.array(rows.column("lang").to_pylist(), object), rows.column("first").to_pylist()
        lang, counts, first = lang[some], [counts[k] for k in some], [np.frombuffer(first[k], "<u2") for k in some]
        languages = sorted(set(lang))
        parts = [spherical_kmeans(vectors(np.vstack([c for c, x in zip(counts, lang, strict=True) if x == name]), idf), CENTROIDS) for name in languages]
        owner = np.repeat(np.arange(len(languages)), [len(p) for p in parts])
        model = Model(idf, languages, np.vstack([*parts, np.zeros((0, SIZE))]).astype(np.float32), owner, np.zeros(16, np.float32))
        least = _limits(model, lang, counts, first) if languages else model.least
        return pa.table({"languages": pa.array([languages], pa.list_(pa.string())), "centroids": [model.centroids.tobytes()], "owner": pa.array([owner.tolist()], pa.list_(pa.int64())), "least": pa.array([least.tolist()], pa.list_(pa.float32()))})

    return run


def _limits(model: Model, lang: np.ndarray, counts: list[np.ndarray], first: list[np.ndarray]) -> np.ndarray:
    """The least accepted cosine of each length class, from the learnt texts that are predicted rightly."""
    names = np.array(model.languages, object)

    def right(lang, counts):
        cos, classes = [np.empty(0)], [np.empty(0, int)]
        for at in range(0, len(lang), 256):
            some = np.vstack(counts[at : at + 256])
            found, c, _ = model.predict(some)
            ok = names[found] == lang[at : at + 256]
            cos.append(c[ok])
            classes.append(length_class(some)[ok])
        return np.concatenate(cos), np.concatenate(classes)

    cos, classes = right(lang, counts)
    of = [cos[classes == k] for k in range(16)]
    for k in range(int(np.log2(BEGINNING + 1))):
        n = 3 * 2**k // 2 - 1 or 1  # about the middle of the class
        longer = np.array([len(f) >= n for f in first], bool)
        if len(of[k]) < LEAST_ROWS and longer.any():
            begun = [np.bincount(f[:n], minlength=SIZE).astype(np.uint8) for f, long in zip(first, longer, strict=True) if long]  # BEGINNING at most
            of[k] = np.concatenate([of[k], right(lang[longer], begun)[0]])
    least = []
    for k in range(16):
        pool = np.empty(0)
        for j in [*range(k, -1, -1), *range(k + 1, 16)]:
            pool = np.concatenate([pool, of[j]]) if len(pool) < LEAST_ROWS else pool
        least.append(SLACK * np.quantile(pool, LOW) if len(pool) else 0)
    return np.array(least, np.float32)


def predict(docs: DataFrame, model: Model | None, names: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """All columns of `docs` and lang_pred, score and rejected, called as `names` says; older columns of these names are replaced."""
    ship_package(docs.sparkSession)
    docs = docs.drop(*names)
    kept = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        at = kept.index("text")
        for batch in batches:
            for first, data, offsets in batches_of(utf8(batch.column(at)), rows=512):
                n = len(offsets) - 1
                part = batch.slice(first, n)
                letter = np.array([bool(t and _LETTER.search(t)) for t in part.column(at).to_pylist()], bool)
                if m is None:
                    who, score, far = np.zeros(n, int), np.zeros(n), np.ones(n, bool)
                else:
                    who, score, far = m.predict(np.vstack(list(trigram_counts(data, offsets))))
                known = letter & (m is not None)
                found = [m.languages[w] if k else UNKNOWN for w, k in zip(who, known, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.string()), pa.array(np.where(known, score, 0.0), pa.float64()), pa.array(far | ~known)], names=[*kept, *names])

    return docs.mapInArrow(run, with_fields(docs, **dict(zip(names, (StringType(), DoubleType(), BooleanType()), strict=True))))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every whole text, learnt from the rows that aren't held out."""
    model = fit(docs, ~held_out())
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
