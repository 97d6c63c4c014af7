"""Exact top-k by inner product: KD-trees per shard, searched best-first, with the kth score passed on between shards.

Vectors become integers floor(scale * x).  The top of one KD-tree, median splits of a bounded sample, cuts space into
CELLS cells at most, each with the tight box of its vectors; every vector goes to its cell, and a cell of more than SHARD
vectors is dealt by hash into shards, so that a vector which many rows share fills several.  Each shard builds its own
KD-tree: median splits on the widest side, with tight bounding boxes.  A query's best score in a box is at most the sum
of max(q * low, q * high) over the sides; nodes are opened in order of that bound until the bound falls under the kth
score so far (equal bounds are opened: ties go to smaller ids).  Cells are visited in the same order: every query first
visits one shard of its cell of greatest bound, then the rest of that cell and the next NEXT ones, then the others, each
time only those whose bound reaches the kth score found so far.  What is sent to all tasks, and what a query carries, is
a box and a bound for each cell, whatever the number of vectors.

Cases: vectors that are null, or hold a null or a component that isn't finite, take no part; vectors of a length other
than the most common one of the table (the larger, if tied) neither; a query with fewer than k candidates gets them
all; repeated ids are separate candidates, but no row with the query's own id is its candidate; rows with a null id
take no part.  Query rows of one id and different vectors are separate queries, each with ranks from 1; equal ones are one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.llm.runtime import ship_package, through_table

#: Vectors in a shard and in a leaf at most (a shard: expected), cells at most, vectors that the cells are cut by,
#: queries that one call holds (expected) and that are searched together, more cells in the second round.
SHARD, LEAF, CELLS, SAMPLE, CALL, BLOCK, NEXT = 4096, 256, 1024, 32_768, 16_384, 1024, 4


class Tree:
    """Arrays of a KD-tree over the rows of x: a box for each node, children, and the rows of each leaf."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.low, self.high, self.kids, self.rows, self.cuts = [], [], [], [], []
        self.x = x
        self._grow(np.arange(len(x)), leaf)
        self.low, self.high = np.array(self.low, np.float64), np.array(self.high, np.float64)

    def _grow(self, rows: np.ndarray, leaf: int) -> int:
        me, part = len(self.kids), self.x[rows]
        low, high = part.min(0), part.max(0)
        self.low.append(low)
        self.high.append(high)
        self.kids.append(None)
        self.rows.append(rows)
        self.cuts.append(None)
        side = int((high - low).argmax())
        if len(rows) > leaf and high[side] > low[side]:
            order = rows[np.argsort(part[:, side], kind="stable")]
            half = len(order) // 2
            self.rows[me] = None
            self.cuts[me] = (side, self.x[order[half], side])
            self.kids[me] = (self._grow(order[:half], leaf), self._grow(order[half:], leaf))
        return me

    def cell(self, x: np.ndarray) -> np.ndarray:
        """For each row of x the leaf whose side of every cut it lies on (at or over a cut: the upper one)."""
        at = np.zeros(len(x), np.int64)
        for node, cut in enumerate(self.cuts):  # parents come before their children
            if cut:
                here = np.flatnonzero(at == node)
                at[here] = np.where(x[here, cut[0]] < cut[1], *self.kids[node])
        return at

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """For each query and node, what no row in the node's box can exceed."""
        return box_bounds(queries, self.low, self.high)


def box_bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T


def search(tree: Tree, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query, id, score) of each query's best k of the tree's rows with a score of floor or more, its own id left out.

    Every round takes each query's open node of greatest bound; queries at the same leaf are scored together."""
    bounds, n = tree.bounds(queries), len(queries)
    kth = floor.astype(np.float64).copy()
    best_s, best_i = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
    open_ = np.full(bounds.shape, -np.inf)  # bounds of nodes on each query's frontier
    open_[:, 0] = bounds[:, 0]
    live = np.arange(n)
    while len(live):
        node = open_[live].argmax(1)
        top = open_[live, node]
        going = (top >= kth[live]) & (top > -np.inf)
        live, node = live[going], node[going]
        open_[live, node] = -np.inf
        for at in np.unique(node):
            mine = live[node == at]
            if tree.kids[at]:
                for kid in tree.kids[at]:
                    open_[mine, kid] = bounds[mine, kid]
                continue
            rows = tree.rows[at]
            s = queries[mine] @ tree.x[rows].T
            s[own[mine][:, None] == ids[rows][None, :]] = -np.inf
            s[s < kth[mine][:, None]] = -np.inf
            all_s = np.hstack([best_s[mine], s])
            all_i = np.hstack([best_i[mine], np.where(s > -np.inf, ids[rows][None, :], np.iinfo(np.int64).max)])
            order = np.lexsort((all_i, -all_s), axis=1)[:, :k]
            best_s[mine], best_i[mine] = np.take_along_axis(all_s, order, 1), np.take_along_axis(all_i, order, 1)
            kth[mine] = np.maximum(kth[mine], best_s[mine, k - 1])
    return [(q, int(best_i[q, j]), int(best_s[q, j])) for q in range(n) for j in range(k) if best_s[q, j] > -np.inf]


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    flat = pa.concat_arrays([c.flatten() for c in chunks]) if chunks else pa.array([], pa.int64())
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


_FOUND = "query_id long, query long, vec_id long, score long"


def _searched(width: int, k: int, leaf: int):
    """Of one (shard, part): its vectors, whose tree is built once, and all its queries, in blocks."""

    def run(key: tuple, vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if vectors.num_rows and queries.num_rows:
            tree, ids = Tree(_matrix(vectors.column("x"), width), leaf), vectors.column("vec_id").to_numpy()
            for at in range(0, queries.num_rows, BLOCK):
                some = queries.slice(at, BLOCK)
                own, query = some.column("query_id").to_numpy(), some.column("query").to_numpy()
                floor = some.column("floor").to_pandas().fillna(-np.inf).to_numpy(np.float64)
                for q, i, s in search(tree, ids, _matrix(some.column("q"), width), own, floor, k):
                    for column, value in zip(out, (int(own[q]), int(query[q]), i, s), strict=True):
                        column.append(value)
        return pa.table({c.split()[0]: pa.array(v, pa.int64()) for c, v in zip(_FOUND.split(", "), out, strict=True)})

    return run


def whole_numbers(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id and x (array<long>) of the vectors that take part."""
    usable = vectors.filter("vec_id IS NOT NULL AND embedding IS NOT NULL").filter(~F.exists("embedding", lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf"))))
    x = usable.select(F.col("vec_id").cast("long"), F.transform("embedding", lambda v: F.floor(v.cast("double") * scale).cast("long")).alias("x"))
    width = x.filter(F.size("x") > 0).groupBy(F.size("x").alias("w")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("w")).select("w").first()
    return x.filter(F.size("x") == (width[0] if width else 0))


def _cells(x: DataFrame, n: int, width: int) -> DataFrame:
    """vec_id, x, cell, cut by a bounded sample, its parts, and shard: a part of it by hash where a cell is large."""
    sample = x.select("x", F.xxhash64(F.lit(3), "vec_id", "x").alias("h")).orderBy("h").limit(SAMPLE).toArrow()  # SAMPLE rows at most
    cells = min(CELLS, max(1, n // SHARD))
    top = Tree(_matrix(sample.column("x"), width), max(1, sample.num_rows // cells))
    top.x = top.rows = None
    shared = x.sparkSession.sparkContext.broadcast(top)  # CELLS nodes, twice, at most

    def placed(batches):
        for batch in batches:
            cell = shared.value.cell(_matrix(batch.column(1), width))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int64())], names=["vec_id", "x", "cell"])

    celled = through_table(x.mapInArrow(placed, "vec_id long, x array<long>, cell long"), "cells")
    parts = celled.groupBy("cell").agg(F.ceil(F.count("*") / SHARD).alias("parts"))  # CELLS rows at most
    return celled.join(F.broadcast(parts), "cell").select("vec_id", "x", "cell", "parts", _shard(F.pmod(F.xxhash64(F.lit(9), "vec_id", "x"), "parts")).alias("shard"))


def _shard(part: Column) -> Column:
    return F.col("cell") * (1 << 32) + part


def _boxes(celled: DataFrame, width: int) -> DataFrame:
    """cell, parts, low and high: the tight box of each cell's vectors, partly made where the vectors lie."""

    def partly(batches):
        for batch in batches:
            x, cell, parts = _matrix(batch.column(0), width), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for c in np.unique(cell):
                here = x[cell == c]
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()), pa.array(parts[cell == c][:1], pa.int64()), pa.array([here.min(0).tolist()], pa.list_(pa.float64())), pa.array([here.max(0).tolist()], pa.list_(pa.float64()))], names=["cell", "parts", "low", "high"])

    some = celled.select("x", "cell", "parts").mapInArrow(partly, "cell long, parts long, low array<double>, high array<double>")
    side = lambda c, f: F.array(*(f(F.get(c, F.lit(k))) for k in range(width))).alias(c)
    return some.groupBy("cell", "parts").agg(side("low", F.min), side("high", F.max))


def _ranked(queries: DataFrame, boxes: DataFrame, width: int) -> DataFrame:
    """query_id, query, q and the cells in order of falling bound, with the bounds and the cells' parts.  Boxes: CELLS rows at most."""
    got = boxes.orderBy("cell").toArrow()
    names, parts = got.column("cell").to_numpy(), got.column("parts").to_numpy()
    shared = queries.sparkSession.sparkContext.broadcast((names, parts, _matrix(got.column("low"), width), _matrix(got.column("high"), width)))

    def run(batches):
        names, parts, low, high = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                bound = box_bounds(_matrix(batch.column(2), width), low, high)
                order = np.argsort(-bound, axis=1, kind="stable")
                lists = ((names[order], pa.int64()), (parts[order], pa.int64()), (np.take_along_axis(bound, order, 1), pa.float64()))
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v.tolist(), pa.list_(kind)) for v, kind in lists)], names=["query_id", "query", "q", "cells", "parts", "bounds"])

    return queries.mapInArrow(run, "query_id long, query long, q array<long>, cells array<long>, parts array<long>, bounds array<double>")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k best rows of `vectors` (vec_id, embedding) for each query row.

    query tells apart the query rows of one id."""
    ship_package(vectors.sparkSession)
    x = through_table(whole_numbers(vectors, scale), "vectors")
    n, first = x.count(), x.select(F.size("x")).first()
    if not n:
        return x.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.col("vec_id").alias("score"), F.col("vec_id").alias("query"))
    width = first[0]
    shards = through_table(_cells(x, n, width), "shards")
    queries = x.filter(is_query).select(F.col("vec_id").alias("query_id"), F.xxhash64("x").alias("query"), F.col("x").alias("q")).dropDuplicates()
    ranked = through_table(_ranked(queries, _boxes(shards, width), width), "ranked-cells")
    first = F.pmod(F.xxhash64(F.lit(13), "query_id", "query"), F.col("z.parts"))  # the part of its best cell that a query visits first
    found = None
    for low, high in ((0, 1), (0, 1 + NEXT), (1 + NEXT, None)):
        if found is not None:
            kth = F.get(F.sort_array(F.collect_list("score"), asc=False), F.lit(k - 1))  # k rows of each visited shard at most
            asked = ranked.join(found.groupBy("query_id", "query").agg(kth.alias("floor")), ["query_id", "query"], "left")
        else:
            asked = ranked.withColumn("floor", F.lit(None).cast("long"))
        size = F.greatest(F.size("cells") - low, F.lit(0)) if high is None else F.lit(high - low)
        cut = lambda c, name: F.slice(c, low + 1, size).alias(name)
        zipped = F.arrays_zip(cut("cells", "cell"), cut("parts", "parts"), cut("bounds", "bound"), F.slice(F.sequence(F.lit(0), F.size("cells") - 1), low + 1, size).alias("place"))
        visit = F.filter(zipped, lambda z: F.col("floor").isNull() | (z["bound"] >= F.col("floor")))
        each = asked.select("query_id", "query", "q", "floor", F.explode(visit).alias("z"))
        if found is None:
            part = F.array(first)
        else:  # all parts, but the one that was visited first
            part = F.filter(F.sequence(F.lit(0).cast("long"), F.col("z.parts") - 1), lambda p: (F.col("z.place") > 0) | (p != first))
        each = each.select("query_id", "query", "q", "floor", F.col("z.cell").alias("cell"), F.explode(part).alias("p"))
        asked = through_table(each.select("query_id", "query", "q", "floor", _shard(F.col("p")).alias("shard")), "asked")
        parts = asked.groupBy("shard").agg(F.ceil(F.count("*") / CALL).alias("parts"))  # a row for each shard
        asked = asked.join(parts, "shard").withColumn("part", F.pmod(F.xxhash64("query_id", "query"), "parts"))
        held = shards.select("shard", "vec_id", "x").join(parts, "shard").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        got = held.select("shard", "part", "vec_id", "x").groupBy("shard", "part").cogroup(asked.groupBy("shard", "part")).applyInArrow(_searched(width, k, LEAF), _FOUND)
        got = through_table(got, "found")
        found = got if found is None else found.unionByName(got)
    best = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "query")
