"""Transitive identities: components over shared keys, quarantine, survivors, best evidence, greedy dedupe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.sources.shared import through_table


def components(rows: DataFrame, node: str, keys: list[str], most_rounds: int = 80) -> DataFrame:
    """Adds `component`, the least node reachable over shared non-null keys.

    Bipartite rounds: a key takes the least label of its rows, a row the least of its keys and of its label's own
    label, until nothing changes. Each key's labels are pre-aggregated, so a key held by many rows is no hot group."""
    edges = through_table(rows.select(F.col(node).alias("n"), F.explode(F.array(*(F.when(F.col(k).isNotNull(), F.concat(F.lit(f"{k}:"), F.col(k).cast("string"))) for k in keys))).alias("k")).filter("k IS NOT NULL").distinct(), "identity-edges")
    label = rows.select(F.col(node).alias("n")).distinct().withColumn("l", F.col("n"))
    for _ in range(most_rounds):
        by_key = edges.join(label, "n").groupBy("k").agg(F.min("l").alias("l"))
        offered = edges.join(by_key, "k").groupBy("n").agg(F.min("l").alias("o"))
        new = label.join(offered, "n", "left").select("n", "l", F.coalesce(F.least("l", "o"), "l").alias("m"))
        jump = new.select(F.col("n").alias("m"), F.col("m").alias("j"))
        new = through_table(new.join(jump, "m", "left").select("n", "l", F.least("m", F.coalesce("j", "m")).alias("m")), "identity-labels")
        done = new.filter("l <> m").isEmpty()
        label = new.select("n", F.col("m").alias("l"))
        if done:
            return rows.join(label.select(F.col("n").alias(node), F.col("l").alias("component")), node, "left")
    raise RuntimeError("identity components did not settle")


def quarantine(df: DataFrame, blocked: Column, component: str = "component") -> DataFrame:
    """Adds `quarantined`: whether any member of the row's component is blocked. Members are counted before the join."""
    bad = df.groupBy(component).agg(F.max(F.coalesce(blocked, F.lit(False))).alias("quarantined"))
    return df.join(bad, component)


def root_chain(df: DataFrame, key: str, parent: str) -> DataFrame:
    """Adds root, depth and cycle: where the chain of parents ends. By pointer doubling, so a few joins whatever the depth.

    A chain that never ends is a cycle and has neither root nor depth; a parent that is no row ends it."""
    known = df.select(F.col(key).alias("_p")).distinct()
    up = df.join(known, F.col(parent) == F.col("_p"), "left").select(F.col(key).alias("_k"), F.coalesce("_p", key).alias("_up"), F.col("_p").isNotNull().cast("long").alias("_n"))
    up = through_table(up, "chains")
    ends = up.filter("_n = 0").select(F.col("_k").alias("_end"))
    step = up
    for _ in range(max(1, int(up.count()).bit_length())):  # no chain without a cycle is longer than the table
        further = step.select(F.col("_k").alias("_f"), F.col("_up").alias("_to"), F.col("_n").alias("_more"))
        step = through_table(step.join(further, F.col("_up") == F.col("_f")).select("_k", F.col("_to").alias("_up"), (F.col("_n") + F.col("_more")).alias("_n")), "chains")
        if step.join(ends, F.col("_up") == F.col("_end"), "left_anti").isEmpty():
            break
    done = step.join(ends, F.col("_up") == F.col("_end"), "left")
    ok = F.col("_end").isNotNull()
    return df.join(done.select("_k", F.when(ok, F.col("_n")).alias("depth"), F.when(ok, F.col("_end")).alias("root"), (~ok).alias("cycle")), F.col(key) == F.col("_k")).drop("_k")


def best_of_identity(df: DataFrame, identity: list[str], order: list[Column], peers: list[Column], value: Column) -> DataFrame:
    """Adds `position` in the identity and `conflict`: whether rows equal to the best in all `peers` differ in value."""
    w = Window.partitionBy(*identity).orderBy(*order)
    ranked = df.withColumn("position", F.row_number().over(w)).withColumn("_p", F.struct(*peers)).withColumn("_b", F.first("_p").over(w))
    top = Window.partitionBy(*identity)
    mine = F.when(F.col("_p") == F.col("_b"), value)
    return ranked.withColumn("conflict", F.coalesce(F.min(mine).over(top) != F.max(mine).over(top), F.lit(False))).drop("_p", "_b")


def _followed(pairs: DataFrame, settled: DataFrame) -> DataFrame:
    """Where chains of rows with one predecessor each begin: (c, o, root, odd), root a row of `settled` (c, o), odd whether
    an odd number of steps leads there. By pointer doubling: as many rounds as the longest chain has binary digits."""
    step = through_table(pairs.select("c", "o", F.col("before").alias("root"), F.lit(True).alias("odd")), "chains")
    while True:
        further = step.select("c", F.col("o").alias("root"), F.col("root").alias("_root"), F.col("odd").alias("_odd"))
        met = step.join(further, ["c", "root"], "left")
        step = through_table(met.select("c", "o", F.coalesce("_root", "root").alias("root"), F.when(F.col("_root").isNull(), F.col("odd")).otherwise(F.col("odd") != F.col("_odd")).alias("odd"), F.col("_root").isNotNull().alias("moved")), "chains")
        if step.filter("moved").isEmpty():
            return step.join(settled.select("c", F.col("o").alias("root")), ["c", "root"], "left_semi").select("c", "o", "odd")
        step = step.drop("moved")


def greedy_dedupe(df: DataFrame, component: str, order: list[str], keys: list[str]) -> DataFrame:
    """Adds `kept`: in order, a row is kept if none of its keys was held by an earlier kept row of its component.

    `order` tells the rows of a component apart.  Of rows equal in all keys only the first can be kept, so the others
    leave at once.  Then in rounds: a row that is the first of the undecided for each of its keys is kept; a row with one
    undecided predecessor is what that isn't, so chains of such rows are settled whole, by pointer doubling; rows that
    share a key with an earlier kept one go.  No task holds a component, and a chain of any length is one round."""
    row = F.struct(*order)
    first = df.groupBy(component, *keys).agg(F.min(row).alias("o"))
    marks = F.array_compact(F.array(*(F.when(F.col(k).isNotNull(), F.concat(F.lit(f"{i}:"), F.col(k).cast("string"))) for i, k in enumerate(keys))))
    open_ = through_table(first.select(F.col(component).alias("c"), "o", F.explode(marks).alias("m")), "undecided")
    kept = None
    while not open_.isEmpty():
        low = open_.groupBy("c", "m").agg(F.min("o").alias("low"))
        told = through_table(open_.join(low, ["c", "m"]), "led")
        second = told.filter("o > low").groupBy("c", "m").agg(F.min("o").alias("second"))
        placed = told.join(second, ["c", "m"], "left")
        before = F.when(F.col("o") > F.col("low"), F.col("low"))
        many = (F.col("o") > F.col("low")) & (F.col("o") > F.col("second"))
        each = through_table(placed.groupBy("c", "o").agg(F.min(before).alias("before"), (F.max(many) | (F.min(before) != F.max(before))).alias("several")), "placed")
        free = each.filter("before IS NULL").select("c", "o")
        chained = _followed(each.filter("before IS NOT NULL AND NOT coalesce(several, false)").select("c", "o", "before"), free)
        won = through_table(free.unionByName(chained.filter("NOT odd").select("c", "o")), "kept")
        lost = chained.filter("odd").select("c", "o")
        kept = won if kept is None else kept.unionByName(won)
        taken = open_.join(won, ["c", "o"], "left_semi").groupBy("c", "m").agg(F.min("o").alias("at"))
        gone = open_.join(taken, ["c", "m"]).filter("o >= at").select("c", "o").unionByName(lost).distinct()
        open_ = through_table(open_.join(gone, ["c", "o"], "left_anti"), "undecided")
    keyless = F.coalesce(*(F.col(k).cast("string") for k in keys)).isNull()
    if kept is None:
        return df.withColumn("kept", keyless)
    found = kept.select(F.col("c").alias("_c"), F.col("o").alias("_o"))
    return df.join(found, (F.col(component) == F.col("_c")) & (row == F.col("_o")), "left").withColumn("kept", keyless | F.col("_o").isNotNull()).drop("_c", "_o")
