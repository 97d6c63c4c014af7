"""Identity queries: components, quarantine, survivors, best evidence, chains."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.operators import identity as I
from marlstone.operators.sequences import aligned
from marlstone.sources.tables import table

QUERIES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def _components(spark, sf):
    """Documents linked by equal text and by a derived account key of a few documents each."""
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("text_key"), F.when(F.col("doc_id") % 3 == 0, F.floor(F.col("doc_id") / 9)).alias("account"), "n_chars")
    return I.components(d, "doc_id", ["text_key", "account"])


_COMP = """
WITH RECURSIVE d AS (SELECT doc_id, sha256(text) AS text_key, CASE WHEN doc_id % 3 = 0 THEN doc_id // 9 END AS account, n_chars FROM documents),
e AS (SELECT DISTINCT a.doc_id AS x, b.doc_id AS y FROM d a JOIN d b ON a.text_key = b.text_key UNION SELECT a.doc_id, b.doc_id FROM d a JOIN d b ON a.account = b.account),
r(x, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.y, r.c FROM r JOIN e ON r.x = e.x),
comp AS (SELECT x AS doc_id, min(c) AS component FROM r GROUP BY 1)
"""


@query(_COMP + "SELECT doc_id, component FROM comp")
def identity_components(spark, sf):
    return _components(spark, sf).select("doc_id", "component")


@query(_COMP + ", t AS (SELECT doc_id, max(toxic) = 1 AS bad FROM labels GROUP BY 1), q AS (SELECT component, bool_or(coalesce(bad, FALSE)) AS quarantined FROM comp LEFT JOIN t USING (doc_id) GROUP BY 1) SELECT doc_id, component, quarantined FROM comp JOIN q USING (component)")
def quarantine_propagate(spark, sf):
    bad = table(spark, sf, "labels").groupBy("doc_id").agg((F.max("toxic") == 1).alias("bad"))
    c = _components(spark, sf).select("doc_id", "component").join(bad, "doc_id", "left")
    return I.quarantine(c, F.col("bad")).select("doc_id", "component", "quarantined")


@query(_COMP + "SELECT component, doc_id AS survivor FROM (SELECT component, d.doc_id, row_number() OVER (PARTITION BY component ORDER BY n_chars DESC, d.doc_id) AS r FROM comp JOIN d USING (doc_id)) WHERE r = 1")
def component_survivor(spark, sf):
    best = F.max_by("doc_id", F.struct("n_chars", -F.col("doc_id")))
    return _components(spark, sf).groupBy("component").agg(best.alias("survivor"))


@query(_COMP + "SELECT component, count(*) AS members, sha256(string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY lpad(CAST(doc_id AS VARCHAR), 12, '0'))) AS digest FROM comp GROUP BY 1")
def component_digest(spark, sf):
    ids = F.transform(F.array_sort(F.collect_set("doc_id")), lambda x: x.cast("string"))
    return _components(spark, sf).groupBy("component").agg(F.count("*").alias("members"), F.sha2(F.array_join(ids, ","), 256).alias("digest"))


@query(_COMP + "SELECT doc_id, CAST(r AS BIGINT) AS copy_number FROM (SELECT c.doc_id, row_number() OVER (PARTITION BY component, text_key ORDER BY c.doc_id) AS r FROM comp c JOIN d USING (doc_id)) WHERE r > 1")
def identical_within_component(spark, sf):
    w = Window.partitionBy("component", "text_key").orderBy("doc_id")
    return _components(spark, sf).withColumn("copy_number", F.row_number().over(w).cast("long")).filter("copy_number > 1").select("doc_id", "copy_number")


@query("WITH RECURSIVE p AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 8 = 0 THEN NULL WHEN s_suppkey % 8 IN (5, 6) AND s_suppkey % 3 = 0 THEN s_suppkey ELSE s_suppkey - 1 END AS parent FROM supplier), r(k, spot, depth) AS (SELECT k, k, 0 FROM p UNION ALL SELECT r.k, p.parent, depth + 1 FROM r JOIN p ON p.k = r.spot WHERE p.parent IS NOT NULL AND depth < 31) SELECT k, CASE WHEN max(depth) >= 31 THEN NULL ELSE CAST(max(depth) AS BIGINT) END AS depth, CASE WHEN max(depth) >= 31 THEN NULL ELSE arg_max(spot, depth) END AS root, max(depth) >= 31 AS cycle FROM r GROUP BY 1")
def root_key_chain(spark, sf):
    k = F.col("s_suppkey")
    parent = F.when(k % 8 == 0, None).when((k % 8).isin(5, 6) & (k % 3 == 0), k).otherwise(k - 1)
    return I.root_chain(table(spark, sf, "supplier").select(k.alias("k"), parent.alias("parent")), "k", "parent").select("k", "depth", "root", "cycle")


_GRADE = "CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END"


@query(f"WITH a AS (SELECT o_custkey, o_orderkey, {_GRADE} AS g, CAST(date_trunc('year', o_orderdate) AS DATE) AS d, floor(o_totalprice / 100000) AS price FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY g, d DESC, o_orderkey) AS position, first_value(g) OVER (PARTITION BY o_custkey ORDER BY g, d DESC, o_orderkey) AS bg, first_value(d) OVER (PARTITION BY o_custkey ORDER BY g, d DESC, o_orderkey) AS bd FROM a), c AS (SELECT o_custkey, count(DISTINCT price) FILTER (g = bg AND d = bd) > 1 AS conflict FROM r GROUP BY 1) SELECT o_custkey, o_orderkey, conflict FROM r JOIN c USING (o_custkey) WHERE position = 1")
def best_of_identity(spark, sf):
    g = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    a = table(spark, sf, "orders").select("o_custkey", "o_orderkey", g.alias("g"), F.trunc(F.col("o_orderdate").cast("date"), "year").alias("d"), F.floor(F.col("o_totalprice") / 100000).alias("price"))
    out = I.best_of_identity(a, ["o_custkey"], [F.col("g"), F.desc("d"), F.col("o_orderkey")], [F.col("g"), F.col("d")], F.col("price"))
    return out.filter("position = 1").select("o_custkey", "o_orderkey", "conflict")


@query()
def greedy_dedupe(spark, sf):
    """In order, a document stays unless a kept one of its component has its text or its account."""
    c = _components(spark, sf).select("doc_id", "component", "text_key", "account")
    return I.greedy_dedupe(c, "component", ["doc_id"], ["text_key", "account"]).select("doc_id", "component", "kept")


def _aligned(spark, sf):
    t = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.array_distinct(F.split(F.lower("text"), "[^a-z]+")).alias("words"))
    return aligned(t, "conv_id", "turn", F.col("role") == "user", "words")


@query()
def sequence_align(spark, sf):
    """Needleman-Wunsch of a conversation's user turns against its other turns: gap -0.65, match 3 * similarity + 0.2."""
    return _aligned(spark, sf)[0].select("conv_id", F.round("score", 6).alias("score"))


@query()
def sequence_pairs(spark, sf):
    """The turns that this alignment puts side by side."""
    return _aligned(spark, sf)[1].select("conv_id", F.col("left").alias("user_turn"), F.col("right").alias("other_turn"), F.round("similarity", 6).alias("similarity"))
