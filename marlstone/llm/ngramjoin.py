"""Exact Jaccard join of word-shingle sets with a token-group matrix, giving each document's component.

1. Every whole text becomes a set of shingle hashes; documents of equal sets are one class, named by its least doc_id.
2. Groups of similar documents: classes that share a band of minhashes are compared with the band's centre (the class
   that meets most others in its bands, the likely original): BANDS pairs for each class at most, so linear.  Those that
   link get one label; a large label is cut into groups of GROUP classes.  A class without a link is a group of its own.
3. Queries meet groups by their prefixes: a set's first n - ceil(t n) + 1 tokens, rare before frequent; sets that link
   share a prefix token.  Two groups of different labels are met if a common token lies early enough and as many prefix
   tokens are common as their sizes need at least.
4. Token-group matrix: for every met group of several classes the union of its members' whole token sets, folded to 32
   bits.  The overlap that a query can have with any member is at most its tokens' hits in the union; only where that
   bound reaches what the sizes need the group is opened, and members are compared until a link is found.  Of a group of
   one class the union is the set itself, so it is compared at once.
5. Components of all links.  Pairs within a label are never needed, so a group of copies costs no square of its size.

No link between different texts is lost: prefix and size bounds hold for any token order, bands only form groups, and
folding can only raise a bound.  The order's frequent tokens are those seen often in the corpus, at most HEAVY of them;
which they are changes speed only.  Hashes have 64 bits.

Cases: a text without words is empty, its own component and linked with nothing; a null doc_id has a null component
and links with nothing; rows that share an id are one node, linked by any of their texts; repeated rows agree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.llm.components import components
from marlstone.llm.runtime import ship_package, through_table
from marlstone.llm.shingles import shingle_sets
from marlstone.llm.textbatch import batches_of, mix, utf8

#: Frequent tokens that the order knows of, and how often one must occur in a stretch of text, of so many
#: tokens, to be counted.
HEAVY, LOCAL, STRETCH = 1 << 17, 4, 4_000_000
#: Classes and tokens in a group at most (expected); bands of minhashes, and minhashes in a band; tokens that one call
#: holds (expected).
GROUP, GROUP_TOKENS, BANDS, ROWS, CALL = 256, 200_000, 4, 3, 600_000
#: Documents with candidates are told by this many id hashes at most, before their texts are shuffled.
BUCKETS = 1 << 19
_MULTIPLIERS = mix(np.arange(11, 11 + BANDS * ROWS, dtype=np.uint64)) | np.uint64(1)
_DIGEST = np.uint64(0xA0761D6478BD642F)


def least_overlap(n: int, per_cent: int) -> int:
    """ceil(t * n)."""
    return -(-per_cent * n // 100)


def _frequent(width: int):
    def counted(tokens: np.ndarray) -> pa.RecordBatch:
        tokens.sort()
        often = np.unique(tokens[LOCAL - 1 :][tokens[LOCAL - 1 :] == tokens[: len(tokens) - LOCAL + 1]])
        times = np.searchsorted(tokens, often, "right") - np.searchsorted(tokens, often)
        return pa.RecordBatch.from_arrays([pa.array(often.view(np.int64)), pa.array(times)], names=["token", "times"])

    def run(batches):
        held, size = np.empty(STRETCH, np.uint64), 0
        for batch in batches:
            for _, data, offsets in batches_of(utf8(batch.column(0))):
                for s in shingle_sets(data, offsets, width):
                    while len(s):
                        some = s[: STRETCH - size]
                        held[size : size + len(some)] = some
                        s, size = s[len(some) :], size + len(some)
                        if size == STRETCH:
                            yield counted(held)
                            size = 0
        if size >= LOCAL:
            yield counted(held[:size])

    return run


def _band_keys(s: np.ndarray) -> np.ndarray:
    least = mix(np.array([(s * m).min() for m in _MULTIPLIERS], np.uint64)).reshape(BANDS, ROWS)
    return mix((least * _MULTIPLIERS[:ROWS]).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def _signatures(width: int, per_cent: int, heavy):
    """heavy: a broadcast pair of arrays, tokens (sorted) and how frequent each is."""

    def run(batches):
        known, often = heavy.value
        for batch in batches:
            for at, data, offsets in batches_of(utf8(batch.column(1))):
                n, d1, d2, bands, prefixes = [], [], [], [], []
                for s in shingle_sets(data, offsets, width):
                    n.append(len(s))
                    d1.append((s * _DIGEST).sum(dtype=np.uint64))
                    d2.append(mix(s).sum(dtype=np.uint64))
                    if not len(s):
                        bands.append(None)
                        prefixes.append(None)
                        continue
                    bands.append(_band_keys(s))
                    p = len(s) - least_overlap(len(s), per_cent) + 1
                    if len(known):
                        k = np.minimum(np.searchsorted(known, s), len(known) - 1)
                        rank = np.where(known[k] == s, often[k], 0)
                        s = s[np.argsort(rank, kind="stable")]
                    prefixes.append(s[:p].view(np.int64))
                rows = [batch.column(0).slice(at, len(n)), pa.array(n, pa.int64()), *(pa.array(np.array(d, np.uint64).view(np.int64)) for d in (d1, d2)), *(pa.array(x, pa.list_(pa.int64())) for x in (bands, prefixes))]
                yield pa.RecordBatch.from_arrays(rows, names=["doc_id", "n", "d1", "d2", "bands", "prefix"])

    return run


def _hits(a: np.ndarray, b: np.ndarray) -> int:
    """How many of `a` are in the sorted `b`."""
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) if len(b) else 0


def _linked(a: np.ndarray, b: np.ndarray, per_cent: int) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < per_cent * len(b):
        return False
    both = _hits(a, b)
    return 100 * both >= per_cent * (len(a) + len(b) - both)


def _sets(rows: pa.Table, width: int) -> dict[int, list[np.ndarray]]:
    """The sets of each group g, of rows (g, text)."""
    g, out = rows.column("g").to_numpy(), {}
    for at, data, offsets in batches_of(utf8(rows.column("text"))):
        for k, s in enumerate(shingle_sets(data, offsets, width), at):
            if len(s):
                out.setdefault(int(g[k]), []).append(s)
    return out


def _pairs(a: list[int], b: list[int]) -> pa.Table:
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _opened(width: int, per_cent: int):
    """Of one call's pairs (a, b), those where a member of one links with a member of the other."""

    def run(key: tuple, texts: pa.Table, pairs: pa.Table) -> pa.Table:
        members, found = _sets(texts, width), []
        for a, b in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist(), strict=True):
            if any(_linked(x, y, per_cent) for x in members.get(a, ()) for y in members.get(b, ())):
                found.append((a, b))
        return _pairs([a for a, _ in found], [b for _, b in found])

    return run


def _union(width: int):
    """Of one call's texts, each group's tokens folded to 32 bits (of a group of one set, with repeats)."""

    def run(key: tuple, texts: pa.Table) -> pa.Table:
        unions = {g: np.sort((sets[0] if len(sets) == 1 else np.unique(np.concatenate(sets))).astype("<u4")) for g, sets in _sets(texts, width).items()}
        return pa.table({"g": pa.array(list(unions), pa.int64()), "tokens": pa.array([u.tobytes() for u in unions.values()], pa.binary())})

    return run


def _bounded(key: tuple, matrix: pa.Table, pairs: pa.Table) -> pa.Table:
    """Of one call's pairs (a, b, need), those whose overlap in the matrix reaches what they need."""
    union = {g: np.frombuffer(t, "<u4") for g, t in zip(matrix.column("g").to_pylist(), matrix.column("tokens").to_pylist(), strict=True)}
    none, found = np.zeros(0, "<u4"), []
    for a, b, need in zip(*(pairs.column(c).to_pylist() for c in ("a", "b", "need")), strict=True):
        x, y = sorted((union.get(a, none), union.get(b, none)), key=len)
        if _hits(x, y) >= need:
            found.append((a, b))
    return _pairs([a for a, _ in found], [b for _, b in found])


def _sizes_fit(n1: Column, n2: Column, m1: Column, m2: Column, per_cent: int) -> Column:
    """Whether a set of n1..m1 tokens may link with one of n2..m2."""
    return (m1 * 100 >= n2 * per_cent) & (m2 * 100 >= n1 * per_cent)


def _bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS))


def _few(rows: DataFrame, key: str) -> DataFrame:
    """The buckets of rows.key: BUCKETS rows at most, whatever the input, so they may be broadcast."""
    return F.broadcast(rows.select(_bucket(key).alias("_b")).distinct())


def _split_by(rows: DataFrame, few: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """`rows` (node, ...) whose node falls in no bucket of few.key, which need no shuffle, and the others."""
    told = rows.withColumn("_k", _bucket("node"))
    return told.join(_few(few, key), F.col("_k") == F.col("_b"), "left_anti").drop("_k"), told.join(_few(few, key), F.col("_k") == F.col("_b"), "left_semi").drop("_k")


def _texts(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """`wanted` (node, ...) with each node's different texts."""
    held = docs.withColumn("_k", _bucket("doc_id")).join(_few(wanted, "node"), F.col("_k") == F.col("_b"), "left_semi")
    held = held.groupBy(F.col("doc_id").alias("node")).agg(F.collect_set("text").alias("texts"))  # repeated rows are one
    return wanted.join(held, "node").withColumn("text", F.explode("texts")).drop("texts", "node")


def _dealt(pairs: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, tokens, ...) dealt to calls of bounded expected size, written; and the groups that each call needs."""
    kept = through_table(pairs, name)
    calls = max(1, -(-int(kept.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]) // CALL))
    dealt = kept.withColumn("call", F.pmod(F.xxhash64("a", "b"), F.lit(calls)))
    return dealt, dealt.select(F.col("call").alias("to"), F.explode(F.array("a", "b")).alias("g")).distinct()


def _verify(pairs: DataFrame, members: DataFrame | None, docs: DataFrame, width: int, per_cent: int) -> DataFrame:
    """Of `pairs` (a, b, tokens) of groups, those (a, b) where a member of one links with a member of the other.

    members: (g, node); None where every group is the class of its name."""
    dealt, groups = _dealt(pairs, "pairs")
    wanted = groups.withColumn("node", F.col("g")) if members is None else groups.join(members, "g")
    shipped = _texts(wanted, docs)
    return shipped.groupBy("to").cogroup(dealt.select("call", "a", "b").groupBy("call")).applyInArrow(_opened(width, per_cent), "a long, b long")


def _qualified(pairs: DataFrame, members: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """Of `pairs` (a, b, tokens, need), those (a, b) that the token-group matrix lets pass."""
    dealt, groups = _dealt(pairs, "group-pairs")
    met = members.join(groups.select("g").distinct(), "g").select("g", "node", "n")
    calls = max(1, -(-int(met.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) // CALL))
    texts = _texts(met.select("g", "node", F.pmod(F.xxhash64("g"), F.lit(calls)).alias("to")), docs)
    matrix = through_table(texts.groupBy("to").applyInArrow(_union(width), "g long, tokens binary"), "token-group-matrix")
    return groups.join(matrix, "g").groupBy("to").cogroup(dealt.select("call", "a", "b", "need").groupBy("call")).applyInArrow(_bounded, "a long, b long")


def _star_pairs(rep: DataFrame, per_cent: int) -> DataFrame:
    """(a, b, tokens): each class and its bands' centres, sizes allowing."""
    keys = rep.select("node", "n", F.explode("bands").alias("h"))
    sizes = through_table(keys.groupBy("h").agg(F.count("*").alias("m")).filter("m > 1"), "bands")
    shared = through_table(keys.join(sizes, "h"), "band-keys")
    scored = shared.join(shared.groupBy("node").agg(F.sum("m").alias("score")), "node")
    centres = through_table(scored.groupBy("h").agg(F.max_by(F.struct("node", "n"), F.struct("score", -F.col("node"))).alias("c")), "centres")
    near = shared.join(centres, "h").filter("c.node <> node").filter(_sizes_fit(F.col("n"), F.col("c.n"), F.col("n"), F.col("c.n"), per_cent))
    return near.select(F.col("node").alias("a"), F.col("c.node").alias("b"), (F.col("n") + F.col("c.n")).alias("tokens")).distinct()


def _met(placed: DataFrame, per_cent: int) -> DataFrame:
    """Pairs (a, b, label1, label2, many, tokens, need) of groups whose members' prefixes leave room for a link."""
    about = placed.groupBy("g").agg(F.min("label").alias("label"), F.max("many").alias("many"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.sum("n").alias("tokens"))
    # Only groups of several classes need their cells made distinct.
    cells = placed.select("g", "many", F.posexplode("prefix").alias("at", "token"))
    matrix = cells.filter("NOT many").select("token", "g", "at").unionByName(cells.filter("many").groupBy("token", "g").agg(F.min("at").alias("at")))
    shared = matrix.withColumn("m", F.count("*").over(Window.partitionBy("token"))).filter("m > 1").select("token", "g", "at")
    shared = through_table(shared.join(about, "g"), "shared-tokens")
    names = ("g", "label", "many", "lo", "hi", "tokens", "at")
    x, y = shared.select("token", *(F.col(c).alias(f"{c}1") for c in names)), shared.select("token", *(F.col(c).alias(f"{c}2") for c in names))
    # A link needs ceil(t / (1 + t) * (n1 + n2)) common tokens; all but the first lie behind it in both sets.
    overlap = F.ceil((F.col("lo1") + F.col("lo2")) * per_cent / F.lit(100 + per_cent) - 1e-9)
    behind = F.least(F.col("hi1") - F.col("at1"), F.col("hi2") - F.col("at2"))
    sides = [f"{c}{k}" for c in names[:-1] for k in (1, 2)]
    fits = _sizes_fit(F.col("lo1"), F.col("lo2"), F.col("hi1"), F.col("hi2"), per_cent) & (behind >= overlap)
    both = x.join(y, "token").filter("g1 < g2 AND label1 <> label2").filter(fits).select(*sides).distinct()
    # Those beyond both prefixes are at most ceil(t n) - 1, the others are in both prefixes.
    need = overlap - F.ceil(F.greatest("hi1", "hi2") * per_cent / F.lit(100) - 1e-9) + 1
    held = shared.groupBy("g").agg(F.collect_list("token").alias("held"))  # of one group's prefixes
    for k in (1, 2):
        both = both.join(held.select(F.col("g").alias(f"g{k}"), F.col("held").alias(f"held{k}")), f"g{k}")
    both = both.filter(F.size(F.array_intersect("held1", "held2")) >= need)
    return both.select(F.col("g1").alias("a"), F.col("g2").alias("b"), "label1", "label2", (F.col("many1") | F.col("many2")).alias("many"), (F.col("tokens1") + F.col("tokens2")).alias("tokens"), overlap.alias("need"))


def join(docs: DataFrame, width: int = 5, per_cent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id that links reach) of every row of `docs`.

    Sets link when 100 * intersection >= per_cent * union."""
    ship_package(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    counted = docs.select("text").mapInArrow(_frequent(width), "token long, times long").groupBy("token").agg(F.sum("times").alias("times"))
    frequent = counted.filter(F.col("times") >= 2 * LOCAL).orderBy(F.desc("times"), "token").limit(HEAVY).toArrow()
    tokens = frequent.column("token").to_numpy().view(np.uint64)
    order = np.argsort(tokens)
    heavy = docs.sparkSession.sparkContext.broadcast((tokens[order], frequent.column("times").to_numpy()[order]))
    del frequent, tokens, order

    signed = docs.mapInArrow(_signatures(width, per_cent, heavy), "doc_id long, n long, d1 long, d2 long, bands array<long>, prefix array<long>")
    signed = through_table(signed, "signatures")
    heavy.unpersist()
    full = signed.filter("n > 0 AND doc_id IS NOT NULL")
    ids = full.select("doc_id", "d1", "d2", "n")
    classes = through_table(ids.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("node")), "class-names")
    # Rows that aren't their class's first are few or of few ids, so only rows whose id falls in their buckets are shuffled.
    other = through_table(ids.join(classes, ["d1", "d2", "n"]).filter("doc_id <> node").select("doc_id", "d1", "d2", "node").distinct(), "copies")
    plain, some = _split_by(full.select(F.col("doc_id").alias("node"), "n", "d1", "d2", "bands", "prefix"), other, "doc_id")
    copies = other.select(F.col("doc_id").alias("_i"), F.col("d1").alias("_1"), F.col("d2").alias("_2"))
    some = some.join(copies, (F.col("node") == F.col("_i")) & (F.col("d1") == F.col("_1")) & (F.col("d2") == F.col("_2")), "left_anti")
    rep = through_table(plain.unionByName(some).select("node", "n", "bands", "prefix"), "classes")
    # An id with several texts joins their classes.
    several = ids.groupBy("doc_id").agg((F.min("d1") != F.max("d1")).alias("differ")).filter("differ").select("doc_id")
    named = other.join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))

    links = _verify(_star_pairs(rep, per_cent), None, docs, width, per_cent)
    label = through_table(components(links.unionByName(named)), "star-labels")

    # Groups: a label's classes, GROUP together.
    sized = label.join(rep.select("node", "n"), "node")
    large = sized.groupBy("label").agg(F.ceil(F.greatest(F.count("*") / GROUP, F.sum("n") / GROUP_TOKENS)).alias("parts"))
    part = through_table(sized.join(large, "label").select("node", "label", F.pmod(F.xxhash64("node"), "parts").alias("part")), "parts")
    first = part.groupBy("label", "part").agg(F.min("node").alias("g"))
    grouped = through_table(part.join(first, ["label", "part"]).select("node", "label", "g"), "groups")
    single, some = _split_by(rep.select("node", "n", "prefix"), grouped, "node")
    single = single.withColumn("label", F.col("node")).withColumn("g", F.col("node")).withColumn("many", F.lit(False))
    some = some.join(grouped, "node", "left").select("node", "n", "prefix", F.coalesce("label", "node").alias("label"), F.coalesce("g", "node").alias("g"), F.col("g").isNotNull().alias("many"))
    placed = single.unionByName(some)

    met = through_table(_met(placed, per_cent), "met-groups")
    members = placed.select("g", "node", "n").distinct()
    passed = met.filter("many").join(_qualified(met.filter("many"), members, docs, width), ["a", "b"], "left_semi")
    chosen = through_table(met.filter("NOT many").unionByName(passed), "chosen-groups")
    more = chosen.join(_verify(chosen.select("a", "b", "tokens"), members.select("g", "node"), docs, width, per_cent), ["a", "b"], "left_semi")
    joined = components(more.select(F.col("label1").alias("a"), F.col("label2").alias("b"))).select(F.col("node").alias("_l"), F.col("label").alias("_to"))

    whole = label.join(joined, F.col("label") == F.col("_l"), "full").select(F.coalesce("node", "_l").alias("node"), F.coalesce("_to", "label").alias("label"))
    by_class = classes.join(whole, "node", "left").select("d1", "d2", "n", F.coalesce("label", "node").alias("component_id"))
    by_class = through_table(by_class, "class-components")
    named = ids.join(by_class, ["d1", "d2", "n"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    rest = signed.filter("n = 0 OR doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return named.unionByName(rest)


def keep_one(docs: DataFrame, width: int = 5, per_cent: int = 80) -> DataFrame:
    """The row of each component's least doc_id (its different texts, if repeated); rows without an id stay."""
    found = through_table(join(docs, width, per_cent).filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("component_id").alias("c"), F.count("*").alias("times")), "components")
    gone = found.filter("doc_id <> c OR times > 1").select(F.col("doc_id").alias("id"), (F.col("doc_id") != F.col("c")).alias("goes"))
    # Rows that go or are repeated are told by their ids' buckets, so most rows stay where they are.
    bucket, buckets = F.pmod(F.xxhash64(docs["doc_id"].cast("long")), F.lit(BUCKETS)), _few(gone, "id")
    still = docs.join(buckets, bucket == buckets["_b"], "left_anti")
    maybe = docs.join(buckets, bucket == buckets["_b"], "left_semi")
    leaving, repeated = gone.filter("goes"), gone.filter("NOT goes")
    stay = maybe.join(leaving, maybe["doc_id"] == leaving["id"], "left_anti")
    once = stay.join(repeated, stay["doc_id"] == repeated["id"], "left_anti")
    return still.unionByName(once).unionByName(stay.join(repeated, stay["doc_id"] == repeated["id"], "left_semi").dropDuplicates(["doc_id", "text"]))
