"""Joins that Spark has no operator for, from windows, unions and equi-joins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.sources.shared import through_table


def asof_join(probes: DataFrame, rates: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    """Each probe with the latest rate at or before it for the same `by`, null if there is none: one shuffle by `by`.

    A null rate value is passed over. Where instants are equal the rate counts as before the probe."""
    out = f"asof_{value}"
    left = probes.withColumn("_side", F.lit(1)).withColumn("_v", F.lit(None).cast(rates.schema[value].dataType))
    right = rates.filter(F.col(value).isNotNull()).select(*by, at, F.lit(0).alias("_side"), F.col(value).alias("_v"))
    w = Window.partitionBy(*by).orderBy(F.col(at), "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right, allowMissingColumns=True).withColumn(out, F.last("_v", ignorenulls=True).over(w))
    return both.filter("_side = 1").select(*probes.columns, out)


def cascade_lookup(df: DataFrame, steps: list[tuple[DataFrame, str, str, str]], out: str) -> DataFrame:
    """Left joins tried in order: (dimension, key in df, key in the dimension, value); the first hit wins."""
    found = []
    for k, (dim, mine, theirs, value) in enumerate(steps):
        df = df.join(dim.select(F.col(theirs).alias(f"_k{k}"), F.col(value).alias(f"_v{k}")).dropDuplicates([f"_k{k}"]), F.col(mine) == F.col(f"_k{k}"), "left")
        found.append(F.col(f"_v{k}"))
    return df.withColumn(out, F.coalesce(*found)).drop(*(c for c in df.columns if c.startswith(("_k", "_v"))))


def field_diff(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """A row for each field that differs between rows of the same key."""
    j = a.select(key, *(F.col(f).cast("string").alias(f"a_{f}") for f in fields)).join(b.select(key, *(F.col(f).cast("string").alias(f"b_{f}") for f in fields)), key)
    each = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"a_{f}").alias("before"), F.col(f"b_{f}").alias("after")) for f in fields))
    return j.select(key, F.inline(each)).filter(~F.col("before").eqNullSafe(F.col("after")))


def _unit(column: pa.ChunkedArray) -> np.ndarray:
    x = np.array(column.to_pylist(), np.float64)
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def nearest(vectors: DataFrame, is_query: Column, k: int, key: str = "vec_id", vector: str = "embedding", shard: int = 4096, block: int = 2048) -> DataFrame:
    """(query, ref, score, rank): each query row's k rows of greatest cosine (9 decimals; ties to the smaller key), itself
    left out.

    Rows are dealt into shards, queries into blocks of bounded expected size; each pair of them is one matrix product
    that returns k rows a query, so no pair of rows is ever shuffled.  Null vectors take no part."""
    x = through_table(vectors.filter(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("x"), F.coalesce(is_query, F.lit(False)).alias("q")), "vectors")
    n, asked = x.agg(F.count("*"), F.count_if("q")).first()
    deal = lambda seed, parts: F.pmod(F.xxhash64(F.lit(seed), "k"), F.lit(max(1, parts)))
    shards, blocks = max(1, -(-n // shard)), max(1, -(-asked // block))

    def best(keys: tuple, refs: pa.Table, queries: pa.Table) -> pa.Table:
        out = [[], [], []]
        if refs.num_rows and queries.num_rows:
            names, mine = refs.column("k").to_numpy(), queries.column("k").to_numpy()
            score = np.round(_unit(queries.column("x")) @ _unit(refs.column("x")).T, 9)
            score[mine[:, None] == names[None, :]] = -np.inf
            order = np.lexsort((np.broadcast_to(names, score.shape), -score), axis=1)[:, :k]
            for i, row in enumerate(order):
                for j in row[score[i, row] > -np.inf]:
                    for column, value in zip(out, (mine[i], names[j], score[i, j]), strict=True):
                        column.append(value)
        return pa.table({"query": pa.array(out[0], pa.int64()), "ref": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    refs = x.select("k", "x", deal(1, shards).alias("s"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("b"))
    queries = x.filter("q").select("k", "x", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("s"), deal(2, blocks).alias("b"))
    found = refs.groupBy("s", "b").cogroup(queries.groupBy("s", "b")).applyInArrow(best, "query long, ref long, score double")
    w = Window.partitionBy("query").orderBy(F.desc("score"), "ref")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


#: Aliases' heads are told by this many hashes at most, before texts' grams are shuffled. Speed only.
BUCKETS = 1 << 16
#: Words of an alias between its first and last that are looked up; an alias with fewer is looked up by its first characters.
INNER, FIRST = 4, 8


def longest_contained(texts: DataFrame, key: str, text: str, aliases: DataFrame, alias_key: str, alias: str) -> DataFrame:
    """For each text, the longest alias that it contains (ties kept); empty aliases are contained in nothing.

    Candidates come from an equi-join: an alias's second to fifth words stand whole in any text that contains it; one of
    fewer words is found by its first FIRST characters (or all, of a shorter one).  A text's grams are dropped where
    they lie unless some alias's head has their hash's bucket."""
    def words(c):
        return F.split(c, " ", -1)
    n = F.size(words(F.col(alias)))
    wordy = n >= INNER + 2
    size = F.least(F.length(alias), F.lit(FIRST))
    head = F.when(wordy, F.xxhash64(F.lit("w"), F.array_join(F.slice(words(F.col(alias)), 2, INNER), " "))).otherwise(F.xxhash64(F.lit("c"), F.substr(F.col(alias), F.lit(1), size)))
    known = through_table(aliases.filter(F.length(alias) > 0).select(F.col(alias_key).alias("_a"), F.col(alias).alias("_alias"), F.when(~wordy, size).alias("_size"), head.alias("_head")), "aliases")
    lengths = sorted(r[0] for r in known.filter("_size IS NOT NULL").select("_size").distinct().collect())  # FIRST at most
    told = F.broadcast(known.select(F.pmod("_head", F.lit(BUCKETS)).alias("_b")).distinct())  # BUCKETS rows at most
    starts = texts.select(F.col(key).alias("_t"), F.col(text).alias("_text"))
    whole = starts.select("_t", F.explode(F.array(words(F.col("_text")))).alias("_w")).filter(F.size("_w") >= INNER + 2)
    grams = F.transform(F.sequence(F.lit(1), F.size("_w") - INNER + 1), lambda i: F.xxhash64(F.lit("w"), F.array_join(F.slice(F.col("_w"), i, F.lit(INNER)), " ")))
    heads = whole.select("_t", F.explode(F.array_distinct(grams)).alias("_head"))
    def pieces(size: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length("_text") - size + 1), lambda i: F.xxhash64(F.lit("c"), F.substr(F.col("_text"), i, F.lit(size))))

    for size in lengths:
        heads = heads.unionByName(starts.filter(F.length("_text") >= size).select("_t", F.explode(F.array_distinct(pieces(size))).alias("_head")))
    heads = heads.join(told, F.pmod("_head", F.lit(BUCKETS)) == F.col("_b"), "left_semi")
    near = heads.join(known.select("_a", "_head"), "_head").select("_t", "_a").distinct()
    hits = near.join(known.select("_a", "_alias"), "_a").join(starts, "_t").filter(F.contains("_text", "_alias"))
    longest = Window.partitionBy("_t").orderBy(F.length("_alias").desc())
    return hits.withColumn("_r", F.rank().over(longest)).filter("_r = 1").select(F.col("_t").alias(key), F.col("_a").alias(alias_key), F.length("_alias").alias("alias_length"))
