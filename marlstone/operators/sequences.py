"""Global alignment of two ordered lists in each group, with the aligned pairs, in blocks of bounded size.

The score of an alignment is 3 * similarity + 0.2 for each pair and -0.65 for each row without one; similarity is the
ratio of shared to all different words.  Where several steps are best, a pair comes before a left row without one, that
before a right row without one.

The lists are cut into blocks of BLOCK rows.  A block of the matrix needs only the last row and column of its neighbours, so
blocks are worked out wave after wave along the anti-diagonals, all groups at once, and keep nothing but those edges.
The best path is followed back from block to block, each worked out again from its edges.  A group whose lists fit one
block takes one task and one wave; one of n and m rows takes (n + m) / BLOCK waves and as many steps back.

Cases: a list may be empty (then no pairs, and the score is that of the rows without one); null or empty word lists are
similar to nothing; the order must tell the rows of a list apart.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.operators.ranking import numbered
from marlstone.sources.shared import through_table

# The score of a row without a pair, of a pair's similarity, and of any pair.
GAP, WEIGHT, PAIR = -0.65, 3.0, 0.2
BLOCK = 256
MATCH, LEFT_ALONE, RIGHT_ALONE = 1, 2, 3


def similarities(a: list[list[str]], b: list[list[str]]) -> np.ndarray:
    """Shared over all different words, for each pair of rows."""
    sides = [[set(w or ()) for w in rows] for rows in (a, b)]
    place = {w: k for k, w in enumerate(set().union(*sides[0]) & set().union(*sides[1]))}
    marks = []
    for rows in sides:
        m = np.zeros((len(rows), len(place)), np.float32)
        for k, words in enumerate(rows):
            m[k, [place[w] for w in words if w in place]] = 1
        marks.append(m)
    both = (marks[0] @ marks[1].T).astype(np.int64)
    sizes = [np.array([len(w) for w in rows], np.int64) for rows in sides]
    either = sizes[0][:, None] + sizes[1][None, :] - both
    return both / np.maximum(either, 1)


def solve(like: np.ndarray, top: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores and steps of a block from its similarities and the scores over and before it, diagonal after diagonal."""
    n, m = like.shape
    score, step = np.zeros((n + 1, m + 1)), np.zeros((n + 1, m + 1), np.int8)
    score[0], score[:, 0] = top, left
    for d in range(2, n + m + 1):
        i = np.arange(max(1, d - m), min(n, d - 1) + 1)
        j = d - i
        pair, over, before = score[i - 1, j - 1] + like[i - 1, j - 1] * WEIGHT + PAIR, score[i - 1, j] + GAP, score[i, j - 1] + GAP
        best = np.where((pair >= over) & (pair >= before), MATCH, np.where(over >= before, LEFT_ALONE, RIGHT_ALONE))
        step[i, j] = best
        score[i, j] = np.choose(best - 1, [pair, over, before])
    return score, step


def _begun(start: float, n: int) -> np.ndarray:
    """Scores along an outer edge from a corner on: one row without a pair after the other."""
    return np.cumsum(np.r_[start, np.full(n, GAP)])


_PART = "i int, j int, kind int, at int, words array<string>, edge array<double>, y int, x int"
#: Kinds of a block's parts: its left rows, its right rows, the scores over it and before it, and where the path comes in.
A, B, TOP, SIDE, PATH = range(5)
_OUT = "i int, j int, kind int, edge array<double>, a int, b int, similarity double, y int, x int"
PAIRED, SCORE = 5, 6


def _solved(group: str, kind: str, trace: bool):
    """A block's task: its edges to the next blocks (forwards), or the path's pairs and where it goes on (back)."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by([("kind", "ascending"), ("at", "ascending")]).to_pylist()
        i, j, name = rows[0]["i"], rows[0]["j"], rows[0][group]
        a, b = ([r["words"] for r in rows if r["kind"] == k] for k in (A, B))
        like = similarities(a, b)
        over = next((np.array(r["edge"]) for r in rows if r["kind"] == TOP), None)
        side = next((np.array(r["edge"]) for r in rows if r["kind"] == SIDE), None)
        corner = over[0] if over is not None else side[0] if side is not None else 0.0
        score, step = solve(like, _begun(corner, len(b)) if over is None else over, _begun(corner, len(a)) if side is None else side)
        out = []
        add = lambda **v: out.append({group: name, "i": i, "j": j, "kind": None, "edge": None, "a": None, "b": None, "similarity": None, "y": None, "x": None} | v)
        path = next(((r["y"], r["x"]) for r in rows if r["kind"] == PATH), None)
        if not trace:
            add(i=i + 1, kind=TOP, edge=score[-1].tolist())
            add(j=j + 1, kind=SIDE, edge=score[:, -1].tolist())
            add(kind=SCORE, edge=[float(score[-1, -1])])
        elif path:
            y, x = (len(a) if path[0] < 0 else path[0]), (len(b) if path[1] < 0 else path[1])
            while y and x:
                if step[y, x] == MATCH:
                    add(kind=PAIRED, a=i * BLOCK + y - 1, b=j * BLOCK + x - 1, similarity=float(like[y - 1, x - 1]))
                y, x = y - (step[y, x] != RIGHT_ALONE), x - (step[y, x] != LEFT_ALONE)
            if (y or i) and (x or j):
                add(i=i - (not y), j=j - (not x), kind=PATH, y=int(y) or -1, x=int(x) or -1)
        kinds = {group: kind_of, "i": pa.int32(), "j": pa.int32(), "kind": pa.int32(), "edge": pa.list_(pa.float64()), "a": pa.int32(), "b": pa.int32(), "similarity": pa.float64(), "y": pa.int32(), "x": pa.int32()}
        return pa.table({c: pa.array([r[c] for r in out], t) for c, t in kinds.items()})

    kind_of = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    return run


def aligned(rows: DataFrame, group: str, order: str, is_left: Column, words: str) -> tuple[DataFrame, DataFrame]:
    """(group, score) of each group, and its pairs (group, left, right: their `order` values, similarity).

    `group` is a long, an int or a string."""
    kind = rows.schema[group].dataType.simpleString()
    told = rows.select(group, F.col(order).alias("o"), F.when(is_left, A).otherwise(B).alias("kind"), F.col(words).alias("words"))
    listed = through_table(numbered(told, [group, "kind"], [F.col("o")], "n").select(group, "o", "kind", (F.col("n") - 1).cast("int").alias("at"), "words"), "lists")
    sizes = listed.groupBy(group).agg(F.count_if(F.col("kind") == A).alias("n"), F.count_if(F.col("kind") == B).alias("m"))
    sizes = sizes.withColumns({"rows": F.ceil(F.col("n") / BLOCK), "columns": F.ceil(F.col("m") / BLOCK)})
    both = sizes.filter("n > 0 AND m > 0")
    block = (F.col("at") / BLOCK).cast("int")
    waves = both.agg(F.max(F.col("rows") + F.col("columns") - 1)).first()[0] or 0
    part = lambda df, **v: df.select(group, "i", "j", *((v.get(c) if v.get(c) is not None else F.lit(None)).cast(t).alias(c) for c, t in (x.rsplit(" ", 1) for x in _PART.split(", ")) if c not in ("i", "j")))

    def parts(blocks: DataFrame, edges: DataFrame | None) -> DataFrame:
        """All that the tasks of these blocks (group, i, j) need."""
        a = part(listed.filter(F.col("kind") == A).withColumn("i", block).join(blocks, [group, "i"]), kind=F.col("kind"), at=F.col("at"), words=F.col("words"))
        b = part(listed.filter(F.col("kind") == B).withColumn("j", block).join(blocks, [group, "j"]), kind=F.col("kind"), at=F.col("at"), words=F.col("words"))
        out = a.unionByName(b)
        if edges is not None:
            out = out.unionByName(part(edges.filter(F.col("kind").isin(TOP, SIDE)).join(blocks, [group, "i", "j"], "left_semi"), kind=F.col("kind"), edge=F.col("edge")))
        return out

    schema = f"`{group}` {kind}, {_OUT}"
    edges = None
    for d in range(int(waves)):
        low, high = F.greatest(F.lit(0), F.lit(d) - F.col("columns") + 1), F.least(F.col("rows") - 1, F.lit(d))
        blocks = both.filter(low <= high).select(group, F.explode(F.sequence(low.cast("int"), high.cast("int"))).alias("i")).withColumn("j", F.lit(d) - F.col("i"))
        new = through_table(parts(blocks, edges).groupBy(group, "i", "j").applyInArrow(_solved(group, kind, False), schema), "edges")
        edges = new if edges is None else edges.unionByName(new)
    alone = sizes.filter("n = 0 OR m = 0").select(group, (F.lit(GAP) * (F.col("n") + F.col("m"))).alias("score"))
    pairs = None
    if edges is None:
        scores = alone
        pairs = listed.limit(0).select(group, F.col("o").alias("left"), F.col("o").alias("right"), F.lit(0.0).alias("similarity"))
        return scores, pairs
    last = both.select(group, (F.col("rows") - 1).cast("int").alias("i"), (F.col("columns") - 1).cast("int").alias("j"))
    scores = alone.unionByName(edges.filter(F.col("kind") == SCORE).join(last, [group, "i", "j"], "left_semi").select(group, F.get("edge", F.lit(0)).alias("score")))
    at, found = last.withColumns({"y": F.lit(-1), "x": F.lit(-1)}), None
    while True:
        comes = part(at, kind=F.lit(PATH), y=F.col("y"), x=F.col("x"))
        new = through_table(parts(at.select(group, "i", "j"), edges).unionByName(comes).groupBy(group, "i", "j").applyInArrow(_solved(group, kind, True), schema), "paths")
        found = new if found is None else found.unionByName(new)
        at = new.filter(F.col("kind") == PATH).select(group, "i", "j", "y", "x")
        if at.isEmpty():
            break
    hit = found.filter(F.col("kind") == PAIRED).select(group, "a", "b", "similarity")
    name = lambda side, c, out: listed.filter(F.col("kind") == side).select(group, F.col("at").alias(c), F.col("o").alias(out))
    return scores, hit.join(name(A, "a", "left"), [group, "a"]).join(name(B, "b", "right"), [group, "b"]).select(group, "left", "right", "similarity")
