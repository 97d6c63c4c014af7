"""Vector code compression: each part of a vector becomes the number of its nearest codebook entry.

Components become integers floor(scale * x); a vector is cut into equal consecutive parts, and each part position has a
codebook, started from the vectors of least id and moved for some rounds: parts go to their nearest entry (squared
distance, ties to the lower number), entries move to the floored mean of their parts, unused entries stay.

Rounds skip distances by norm-of-sum bounds.  The codebooks of all rounds are kept.  For every group of entries a part
remembers the distance to the group's nearest entry (its own entry left out) and the round of that scan.  Later on that
distance can have shrunk by no more than the greatest net displacement of the group's entries between the two rounds,
|C(now) - C(then)|, the norm of the summed moves: never more, mostly less, than the sum of their norms.  A group whose
bound stays over the exact distance to the part's own entry isn't scanned; any other is scanned exactly and stamped anew.
Bounds are stored rounded down; integers below 2**53 are exact, so skipping changes no result.

Each round maps the vectors where they lie, writes them with their bounds, and sums parts by entry; entries (parts *
entries * width numbers) are all that the driver sees.

Cases: vectors that are null, or hold a null or a component that isn't finite, take no part; vectors of a length other
than the most common one (the larger, if tied) neither; with fewer vectors than entries the codebooks are as small;
rows with a null id are encoded but start a codebook last; repeated ids are separate vectors, the start is ordered by id
and then components; an empty table gives no rows; a width that the parts don't divide gives parts that differ by one.
Sums of squared distances must fit 64 bits (components under 130,000 at the scale of 1024 and 64 sides).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from marlstone.llm.runtime import ship_package, through_table, with_fields

#: Parts, entries of a codebook, rounds of moves, factor of the components, groups of entries that share a bound, vectors scanned together.
PARTS, ENTRIES, ROUNDS, SCALE, GROUPS, BLOCK = 4, 256, 4, 1024, 8, 4096
EXACT = float(1 << 52)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of every row of x to every row of c (integers)."""
    most = max(np.abs(x).max(initial=0), np.abs(c).max(initial=0))
    if 4.0 * float(most) ** 2 * x.shape[1] < EXACT:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in c], axis=1) if len(c) else np.zeros((len(x), 0), np.int64)


def groups_of(start: np.ndarray, n: int = GROUPS) -> list[np.ndarray]:
    """The entries in groups of neighbours along the widest side of the first codebook; each group in order of number."""
    side = int(np.ptp(start, axis=0).argmax()) if start.size else 0
    return [np.sort(g) for g in np.array_split(np.argsort(start[:, side], kind="stable"), min(n, len(start)))]


class Part:
    """The codebook history of one part position: assigns parts by what their bounds leave open."""

    def __init__(self, history: list[np.ndarray], groups: list[np.ndarray]):
        self.history, self.groups, self.now = history, groups, history[-1]
        self.group_of = np.empty(len(self.now), np.int64)
        for g, members in enumerate(groups):
            self.group_of[members] = g
        moved = [np.sqrt(((self.now - then).astype(np.float64) ** 2).sum(1)) for then in history]
        #: For each round and group, the greatest net displacement since, rounded up.
        self.net = np.array([[m[members].max() * (1 + 1e-9) for members in groups] for m in moved])

    def _scan(self, x: np.ndarray, g: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Least distance, its entry and the second least distance in a group."""
        d = squared(x, self.now[self.groups[g]])
        first = d.argmin(1)
        least = np.take_along_axis(d, first[:, None], 1)[:, 0]
        np.put_along_axis(d, first[:, None], np.iinfo(np.int64).max, 1)
        return least, self.groups[g][first], d.min(1)

    def assign(self, x: np.ndarray, code: np.ndarray | None, low: np.ndarray | None, stamp: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
        """code, squared distance, bounds (int, rounded down), their rounds, and how many groups were scanned."""
        n, today = len(x), len(self.history) - 1
        if code is None:
            best, code = np.full(n, np.iinfo(np.int64).max), np.full(n, len(self.now))
            low, stamp, open_ = np.zeros((n, len(self.groups)), np.int64), np.zeros((n, len(self.groups)), np.int64), np.ones((n, len(self.groups)), bool)
        else:
            best = ((x - self.now[code]) ** 2).sum(1)
            left = low - self.net[stamp, np.arange(len(self.groups))[None, :]]
            open_ = left <= np.sqrt(best.astype(np.float64))[:, None] * (1 + 1e-9)
            low, stamp = low.copy(), stamp.copy()
        old, code, scanned = code, code.copy(), {}
        for g in range(len(self.groups)):
            rows = np.flatnonzero(open_[:, g])
            scanned[g] = (rows, *self._scan(x[rows], g))
            _, least, entry, _ = scanned[g]
            nearer = (least < best[rows]) | ((least == best[rows]) & (entry < code[rows]))
            best[rows[nearer]], code[rows[nearer]] = least[nearer], entry[nearer]
        count = int(open_.sum())
        for g in range(len(self.groups)):
            left_behind = np.flatnonzero((old != code) & ~open_[:, g] & (old < len(self.now)) & (self.group_of[np.minimum(old, len(self.now) - 1)] == g))
            for rows, least, entry, second in (scanned[g], (left_behind, *self._scan(x[left_behind], g))):
                bound = np.where(entry == code[rows], second, least).astype(np.float64)
                low[rows, g] = np.minimum(np.floor(np.sqrt(bound) * (1 - 1e-9)), 2**31 - 1)
                stamp[rows, g] = today
            count += len(left_behind)
        return code, best, low, stamp, count


def integers(vectors: DataFrame, scale: int = SCALE, *carried: str) -> DataFrame:
    """The carried columns and x (array<long>) of the vectors that take part."""
    odd = F.exists("embedding", lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    x = vectors.filter(F.col("embedding").isNotNull()).filter(~odd)
    x = x.select(*carried, F.transform("embedding", lambda v: F.floor(v.cast("double") * scale).cast("long")).alias("x")).filter(F.size("x") > 0)
    width = x.groupBy(F.size("x").alias("w")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("w")).select("w").first()
    return x.filter(F.size("x") == (width[0] if width else 0))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _assigned(width: int, cuts: list[int], books: list[list[np.ndarray]], groups: list[list[np.ndarray]], fresh: bool, carried: list[str]):
    """Batches of (carried, x[, code, low, stamp]) with codes, bounds, stamps, error and scans of this round."""

    def run(batches):
        parts = [Part(h, g) for h, g in zip(books, groups, strict=True)]
        each = [len(g) for g in groups]
        at_group = np.concatenate([[0], np.cumsum(each)])
        k = len(carried)
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                n, x = batch.num_rows, _matrix(batch.column(k), width)
                codes, lows, stamps, error, scans = [], [], [], np.zeros(n, np.int64), 0
                before = None if fresh else [_matrix(batch.column(k + 1 + j), w) for j, w in enumerate((len(parts), at_group[-1], at_group[-1]))]
                for p, part in enumerate(parts):
                    known = (None, None, None) if fresh else (before[0][:, p].astype(np.int64), *(b[:, at_group[p] : at_group[p + 1]].astype(np.int64) for b in before[1:]))
                    code, best, low, stamp, count = part.assign(x[:, cuts[p] : cuts[p + 1]], *known)
                    error += best
                    scans += count
                    for got, value in ((codes, code[:, None]), (lows, low), (stamps, stamp)):
                        got.append(value)
                lists = [pa.ListArray.from_arrays(np.arange(0, n * m.shape[1] + 1, m.shape[1]).astype(np.int32), pa.array(m.ravel(), pa.int32())) for m in (np.hstack(codes), np.hstack(lows), np.hstack(stamps))]
                scanned = np.zeros(n, np.int64)
                scanned[:1] = scans
                yield pa.RecordBatch.from_arrays([*batch.columns[: k + 1], *lists, pa.array(error), pa.array(scanned)], names=[*carried, "x", "code", "low", "stamp", "error", "scans"])

    return run


def _moved(state: DataFrame, width: int, cuts: list[int], last: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after a move: floored means by entry, summed first in each task and then over tasks."""
    size = len(last[0])

    def run(batches):
        sums, counts = np.zeros((size, width), np.int64), np.zeros((len(last), size), np.int64)
        for batch in batches:
            x, code = _matrix(batch.column(0), width), _matrix(batch.column(1), len(last))
            for p in range(len(last)):
                np.add.at(sums[:, cuts[p] : cuts[p + 1]], code[:, p], x[:, cuts[p] : cuts[p + 1]])
                counts[p] += np.bincount(code[:, p], minlength=size)
        p, entry = np.nonzero(counts)
        values = [sums[e, cuts[q] : cuts[q + 1]].tolist() for q, e in zip(p, entry, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[p, entry], pa.int64()), pa.array(values, pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

    partial = state.select("x", "code").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    total = partial.select("part", "entry", "n", F.posexplode("sums").alias("pos", "s")).groupBy("part", "entry", "pos").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    out = [b.copy() for b in last]
    for r in total.select("part", "entry", "pos", F.expr("(s - pmod(s, n)) div n").alias("mean")).collect():  # an entry's component each
        out[r["part"]][r["entry"], r["pos"]] = r["mean"]
    return out


def compress(vectors: DataFrame, *carried: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray], list[int]]:
    """The coded vectors (carried columns, of which the first is the id; code: array<int>; error: long), the codebooks of all
    parts, and how many groups of entries each round scanned (all of them in the first)."""
    spark = vectors.sparkSession
    ship_package(spark)
    carried = carried or ("vec_id",)
    x = integers(vectors, scale, *carried)
    seeds = x.orderBy(F.asc_nulls_last(carried[0]), "x").limit(entries).select("x").collect()  # `entries` rows at most
    kinds = ", ".join(f"`{c}` {x.schema[c].dataType.simpleString()}" for c in carried)
    if not seeds:
        return x.select(*carried, F.array().cast("array<int>").alias("code"), F.lit(0).cast("long").alias("error")), [], []
    start = np.array([r["x"] for r in seeds], np.int64)
    width = start.shape[1]
    cuts = [p * width // parts for p in range(parts + 1)]
    books = [[start[:, cuts[p] : cuts[p + 1]]] for p in range(parts)]
    groups = [groups_of(b[0]) for b in books]
    schema, scans = f"{kinds}, x array<long>, code array<int>, low array<int>, stamp array<int>, error long, scans long", []
    state = x
    for r in range(rounds + 1):
        fresh = r == 0
        held = state.select(*carried, "x") if fresh else state.select(*carried, "x", "code", "low", "stamp")
        state = through_table(held.mapInArrow(_assigned(width, cuts, books, groups, fresh, list(carried)), schema), f"codes-{r}")
        scans.append(state.agg(F.sum("scans")).first()[0])
        if r < rounds:
            for book, moved in zip(books, _moved(state, width, cuts, [b[-1] for b in books]), strict=True):
                book.append(moved)
    return state.select(*carried, "code", "error"), [b[-1] for b in books], scans


def digest(codebooks: list[np.ndarray]) -> str:
    """sha256 of all components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(str(v) for book in codebooks for v in book.ravel().tolist()).encode()).hexdigest()


def hex_code(code: Column) -> Column:
    """Two hex digits for each part."""
    return F.lower(F.array_join(F.transform(code, lambda c: F.lpad(F.hex(c.cast("long")), 2, "0")), ""))


def decompress(coded: DataFrame, codebooks: list[np.ndarray], scale: int = SCALE) -> DataFrame:
    """The coded rows with `embedding` (array<double>): what the codes stand for, in the vectors' own units."""

    def run(batches):
        for batch in batches:
            code = _matrix(batch.column(batch.schema.get_field_index("code")), max(1, len(codebooks)))
            back = np.hstack([book[code[:, p]] for p, book in enumerate(codebooks)]) / scale if codebooks else np.zeros((batch.num_rows, 0))
            lists = pa.ListArray.from_arrays(np.arange(0, back.size + 1, max(1, back.shape[1]))[: batch.num_rows + 1].astype(np.int32), pa.array(back.ravel(), pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "embedding"])

    return coded.mapInArrow(run, with_fields(coded, embedding=ArrayType(DoubleType())))


def with_label_error(coded: DataFrame, label: str = "label") -> DataFrame:
    """Adds label_error: the error summed over the rows of an equal label (nulls are one label)."""
    per = coded.groupBy(F.col(label).alias("_l")).agg(F.sum("error").alias("label_error"))
    return coded.join(per, F.col(label).eqNullSafe(F.col("_l")), "left").drop("_l")
