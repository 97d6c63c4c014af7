"""Line dedup by a deletion-neighbourhood join: of equal or nearly equal lines only the earliest stays.

A line's words are its lower-cased parts between white space.  Lines of at least `min_words` words are judged (by default
all that have a word); two are equal if their words are, and near if both have at least `near_words` words and one word
changed, added or left out turns one into the other (edit distance 1 over words; by default of five words or more, so
four fifths agree).  A line goes if an earlier line (by doc_id, then place) equals it or is near it.

The join: every line that can have a near line emits the hash of each variant with one word deleted, with the place of
the deletion, and of itself.  Lines of equal length are near exactly if they share a variant with the deletion at the
same place; a line is near one with a word more exactly if it is itself a variant of that one.  So the lines of a key
need only be compared with the key's earliest (or with the single whole line): work is linear in each group.  The edit
distance is then verified on the words themselves.  Which lines can have a near line is told by a pigeonhole: near lines
agree in their first or last half, so lines whose halves are met nowhere else emit nothing.

Native: DataFrame functions only.  Cases: a null text stays null; empty lines, and those with fewer words than
min_words, always stay; rows with a null doc_id have no place in the order, so they stay as they are and make no line go;
rows that share an id count as one document, so a line that they repeat at the same place is one line; a text that loses
all its lines is empty; columns of any other names are returned as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.llm.runtime import through_table

MIN_WORDS, NEAR_WORDS = 1, 5
#: Keys that matter are told by this many hashes, 64 to a row, before rows are shuffled. Speed only.
BUCKETS = 1 << 25
_MASK = (1 << 40) - 1


def line_words(line: Column) -> Column:
    """The lower-cased words; other white space than blanks is rare, so it becomes blanks first and the split is plain."""
    plain = F.when(line.rlike("[\t\x0b-\r]"), F.translate(line, "\t\x0b\x0c\r", "    ")).otherwise(line)
    return F.array_remove(F.split(F.lower(plain), " "), "")


def _once(c: Column) -> Column:
    """The same value from a generator, so that an expression used several times above is evaluated once."""
    return F.explode(F.array(c))


def _lines(docs: DataFrame, min_words: int) -> DataFrame:
    """doc_id, line, raw (a hash of the line as it stands) and words of each line that is judged."""
    at = docs.filter("doc_id IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    at = at.select("doc_id", "line", F.xxhash64("raw").alias("raw"), _once(line_words(F.col("raw"))).alias("words"))
    return at.filter(F.size("words") >= min_words)


def _hashes(words: Column) -> list[Column]:
    return [F.xxhash64(words).alias("h1"), F.xxhash64(F.lit(77), words).alias("h2")]


def _first(doc_id: Column, line: Column) -> Column:
    """Orders lines."""
    return F.struct(doc_id.alias("doc_id"), line.alias("line"))


def _halves(near_words: int) -> Column:
    """Keys of a line's halves, for lines of its own length and of one word less: first and last halves alternate."""
    w, n = F.col("words"), F.size("words")
    def key(c):
        return F.array(F.xxhash64(F.lit(1), c, F.slice(w, 1, c)), F.xxhash64(F.lit(2), c, F.slice(w, -c, c)))
    whole, less = F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")
    return F.when(n >= near_words, F.when(whole == less, key(whole)).otherwise(F.concat(key(whole), key(less))))


def _among(rows: DataFrame, of: Column, keys: DataFrame, key: Column, how: str = "left_semi") -> DataFrame:
    """The rows whose `of` can be one of the keys, by buckets as bits (left_anti: those whose can't): BUCKETS / 64 rows at
    most are broadcast, whatever the input."""
    place = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).alias("_b")
    bits = keys.select(place).groupBy(F.shiftright("_b", 6).alias("_w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_b & 63 AS int))")).alias("_bits"))
    told = rows.withColumn("_k", F.pmod(F.xxhash64(of), F.lit(BUCKETS)))
    met = F.expr("shiftright(_k, 6) = _w AND (shiftright(_bits, cast(_k & 63 AS int)) & 1L) = 1L")
    return told.join(F.broadcast(bits), met, how).drop("_k")


def _variants(lines: DataFrame) -> DataFrame:
    """From (first, words): a row for each deleted word, as a line of equal length and as one of a word less would have
    it, and one for the whole line (whole: true for this, false for those of a word less, null for equal length)."""
    def value(seed: int, word: Column, k: Column) -> Column:
        return F.xxhash64(F.lit(seed), word, k).bitwiseAND(F.lit(_MASK))
    # Dealt by line before they are cut, so that the sums over a line's words need no shuffle of a row a word.
    each = lines.repartition("first").select("first", F.size("words").alias("n"), F.posexplode("words").alias("k", "w"))
    each = each.select("first", "n", "k", *(value(s, F.col("w"), F.col("k")).alias(f"a{s}") for s in (1, 2)), *(value(s, F.col("w"), F.col("k") - 1).alias(f"b{s}") for s in (1, 2)))
    line = Window.partitionBy("first", "n").orderBy("k")
    upto, whole = line.rowsBetween(Window.unboundedPreceding, 0), line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = [(F.sum(f"a{s}").over(upto) - F.col(f"a{s}")).alias(f"p{s}") for s in (1, 2)]
    after = [(F.sum(f"{c}{s}").over(whole) - F.sum(f"{c}{s}").over(upto)).alias(f"{c}s{s}") for c in "ab" for s in (1, 2)]
    sums = each.select("first", "n", "k", "a1", "a2", *before, *after)
    same = F.struct(F.xxhash64(F.lit("="), "n", "k", F.col("p1") + F.col("as1"), F.col("p2") + F.col("as2")).alias("key"), F.lit(None).cast("boolean").alias("whole"))
    short = F.struct(F.xxhash64(F.lit("w"), F.col("n") - 1, F.col("p1") + F.col("bs1"), F.col("p2") + F.col("bs2")).alias("key"), F.lit(False).alias("whole"))
    itself = F.struct(F.xxhash64(F.lit("w"), "n", F.col("a1") + F.col("as1"), F.col("a2") + F.col("as2")).alias("key"), F.lit(True).alias("whole"))
    return sums.select("first", F.explode(F.when(F.col("k") == 0, F.array(same, short, itself)).otherwise(F.array(same, short))).alias("v")).select("first", "v.key", "v.whole")


def _near(distinct: DataFrame, docs: DataFrame, min_words: int) -> DataFrame:
    """The first places of the lines that go because an earlier line is near."""
    # Pigeonhole: lines that share a half with another line.
    halves = distinct.filter("halves IS NOT NULL").select("first", F.explode("halves").alias("half"))
    shared = through_table(halves.groupBy("half").agg(F.min("first").alias("lo"), F.max("first").alias("hi")).filter("lo <> hi").select("half"), "shared-halves")
    maybe = _among(halves, F.col("half"), shared, F.col("half"))
    at = through_table(maybe.join(shared, "half", "left_semi").select("first").distinct(), "line-candidates")
    # Their words, from the documents that hold their first places.
    holders = _among(docs, F.col("doc_id"), at, F.col("first.doc_id"))
    words = _lines(holders.select("doc_id", "text"), min_words).select(_first(F.col("doc_id"), F.col("line")).alias("first"), "words")
    lines = through_table(_among(words, F.col("first"), at, F.col("first")).join(at, "first", "left_semi").dropDuplicates(["first"]), "line-words")

    v = through_table(_variants(lines), "variants")
    low = lambda cond: F.min(F.when(cond, F.col("first")))
    groups = v.groupBy("key").agg(F.min("first").alias("lo"), F.max("first").alias("hi"), low(F.col("whole")).alias("w"), low(~F.col("whole")).alias("l"))
    met = through_table(groups.filter("(w IS NULL AND l IS NULL AND lo <> hi) OR (w IS NOT NULL AND l IS NOT NULL)"), "variants-met")
    # A line of equal length meets the key's earliest, the whole line the earliest of a word more, those the whole line.
    by = F.when(F.col("whole").isNull(), F.col("lo")).when(F.col("whole"), F.col("l")).otherwise(F.col("w"))
    found = _among(v, F.col("key"), met, F.col("key")).join(met, "key").withColumn("by", by).filter(F.col("by") < F.col("first")).groupBy("first").agg(F.min("by").alias("by"))
    # Verify the distance on the words.
    a = lines.select("first", F.col("words").alias("a"))
    b = lines.select(F.col("first").alias("by"), F.col("words").alias("b"))
    return found.join(a, "first").join(b, "by").filter(within_one(F.col("a"), F.col("b"))).select("first")


def within_one(a: Column, b: Column) -> Column:
    """Whether the edit distance of two word arrays is 1 at most: what follows the common start must be equal but for a word."""
    n, m = F.size(a), F.size(b)
    differ = F.filter(F.transform(F.arrays_zip(a.alias("x"), b.alias("y")), lambda z, k: F.when(z["x"].eqNullSafe(z["y"]), None).otherwise(k)), lambda k: k.isNotNull())
    at = F.coalesce(F.get(differ, F.lit(0)), F.least(n, m))  # words before the first difference
    def rest(x, skip):
        return F.slice(x, at + 1 + skip, F.greatest(F.size(x) - at - skip, F.lit(0)))
    return F.when(n == m, rest(a, 1) == rest(b, 1)).when(n == m + 1, rest(a, 1) == rest(b, 0)).when(m == n + 1, rest(a, 0) == rest(b, 1)).otherwise(False)


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS, names: tuple[str, str, str] = ("n_lines", "n_exact", "n_near")) -> DataFrame:
    """All columns of `docs`, the text without the lines that go, and n_lines, n_exact and n_near (lines that went),
    called as `names` says; older columns of these names are replaced."""
    docs = docs.drop(*names)
    texts = docs.select("doc_id", "text")
    judged = _lines(texts, min_words)
    lines = through_table(judged.select("doc_id", "line", "raw", *_hashes(F.col("words")), _halves(near_words).alias("halves")), "lines")
    here = _first(F.col("doc_id"), F.col("line"))
    distinct = lines.groupBy("h1", "h2").agg(F.min(here).alias("first"), F.count("*").alias("n"), F.min_by("halves", here).alias("halves"))
    distinct = through_table(distinct, "distinct-lines")
    near = _near(distinct.select("first", "halves"), texts, min_words).withColumn("near", F.lit(True))
    bad = distinct.select("h1", "h2", "first", "n").join(near, "first", "left").filter("n > 1 OR near").select("h1", "h2", "first", F.coalesce("near", F.lit(False)).alias("near"))
    gone = lines.select("doc_id", "line", "raw", "h1", "h2").join(bad, ["h1", "h2"])
    gone = gone.filter(F.col("near") | (F.col("first") != here)).withColumn("exact", F.col("first") != here)
    per_doc = gone.groupBy("doc_id").agg(F.collect_set(F.struct("line", "raw", "exact")).alias("gone"))  # lines of one document
    per_doc = through_table(per_doc.withColumnRenamed("doc_id", "of"), "lines-gone")

    # Documents that lose nothing need not be shuffled.  The caller's columns lie in a struct, where no name can clash.
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    who = F.col("row.doc_id")
    none = F.lit(0).cast("long")
    text = F.col("row.text")
    n_lines = F.when(text.isNull(), none).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    kept = [F.col("row").getField(c).alias(c) for c in docs.columns]
    plain = _among(held, who, per_doc, F.col("of"), "left_anti").select(*kept, *(c.alias(name) for c, name in zip((n_lines, none, none), names, strict=True)))
    joined = _among(held, who, per_doc, F.col("of")).join(per_doc, who == F.col("of"), "left")
    return _rebuilt(joined, docs.columns, names).unionByName(plain)


def _rebuilt(joined: DataFrame, columns: list[str], names: tuple[str, str, str]) -> DataFrame:
    """From row and gone: the row with the text kept, and the counts."""
    split = joined.select("row", "gone", _once(F.split("row.text", "\n")).alias("parts"))
    # Rows that share an id may differ: a line goes only where it is the line that was judged.
    mine = F.filter(F.coalesce("gone", F.array().cast(joined.schema["gone"].dataType)), lambda g: F.xxhash64(F.get(F.col("parts"), g["line"])) == g["raw"])
    told = split.select("row", "parts", _once(mine).alias("mine"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.transform("mine", lambda g: g["line"]))
    text = F.when(F.size("mine") == 0, F.col("row.text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(F.col("parts"), i)), "\n"))
    exact = F.size(F.filter("mine", lambda g: g["exact"])).cast("long")
    lines = F.when(F.col("row.text").isNull(), 0).otherwise(F.size("parts")).cast("long")
    counts = (lines, exact, F.size("mine").cast("long") - exact)
    return told.select(*((text if c == "text" else F.col("row").getField(c)).alias(c) for c in columns), *(c.alias(name) for c, name in zip(counts, names, strict=True)))
