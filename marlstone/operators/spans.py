"""All names of a catalog in running text: a filter over a dictionary of any size, greedy spans, negation, routing.

A text is cut at separators into pieces; a piece and the names are compared in one form (compatibility form, lower case,
no blanks or punctuation).  A piece that is a name as a whole is that name.  In any other piece every occurrence of a
name of LEAST_INSIDE characters or more is found, and spans are taken from the left, at each place the longest, without
overlap.  A span beside a word of absence is excluded; a name of one item is matched, a confirmed name of several is a
group, any other is ambiguous.  Texts are read once: a Bloom filter of the names and of their beginnings tells where in a
piece a name may stand, and what may be one is looked up by a join with the names, so the filter decides nothing.

Cases: a null or blank text has no pieces; names that are short or generic are left out; names of one form are one name
with all their items; repeated rows of a text id are read together.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.text import nfkc
from marlstone.sources.shared import through_table

# What is left out of names, what cuts texts, words of absence before and behind a name, how near they stand.
DROPPED = "[\\s\u200b-\u200d\ufeff\"'’‘`´.,，。:：;；!?！？·・|｜/\\\\()\\[\\]{}<>《》〈〉「」『』【】_\\-—–~～+＋=＝♡♤♧◇✦❖⸝╻┊𓆩𓆪☁]"
SEPARATORS = "[\r\n┊｜|・⸝╻▸›»→、,，。;；]+"
ABSENT_BEFORE = "(?:[沒没]有|不含|不[帶带]|未有|未持有|未收|缺少|缺|[無无]|已售|售出|拔掉)$"
ABSENT_AFTER = "^(?:[沒没]有|不含|不[帶带]|未有|未持有|未收|缺少|已售|售出|拔掉)"
NEAR = 5
#: Characters of a name at least, and of one that is looked for inside a piece; names that the filter is laid out for at most.
LEAST, LEAST_INSIDE, BLOCK = 2, 3, 1 << 25
#: Bytes of the shortest beginning that the filter knows; each further one is twice as long.
BEGIN = 8


# The same characters one by one: translating them takes a small part of the time that patterns of long classes take.
_DROPPED = re.sub(r"\\(.)", r"\1", DROPPED[3:-1].replace("\u200b-\u200d", "\u200b\u200c\u200d"))
_SEPARATORS = SEPARATORS[1:-2]


def _bare(name: Column, kept: str = "") -> Column:
    return F.regexp_replace(F.translate(F.lower(name), _DROPPED, ""), f"(?U)[\\s&&[^{kept}]]" if kept else "(?U)\\s", "")


def form(name: Column) -> Column:
    """The form in which names and pieces are compared."""
    return _bare(nfkc(name))


def lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    """id and a text's pieces in their compared form, a line each; one that has nothing left is an empty line."""
    cut = F.filter(F.transform(F.split(F.translate(text, _SEPARATORS, "\n" * len(_SEPARATORS)), "\n", -1), lambda p: F.trim(p)), lambda p: p != "")
    once = texts.filter(F.col(text).isNotNull()).select(F.col(key).alias("id"), F.array_join(cut, "\n").alias("lines"))  # read thrice by the form, cut once
    return once.select("id", _bare(nfkc(F.col("lines")), "\n").alias("lines"))  # no piece has a line end, and no form goes beyond one


def _known(names: DataFrame, name: str, item: str, generic: tuple[str, ...]) -> DataFrame:
    names = names.select(F.col(name).alias("name"), F.col(item).alias("item")).filter("item IS NOT NULL")
    ascii = names.filter(~F.col("name").rlike("[^\\x00-\\x7F]")).select(_bare(F.col("name")).alias("term"), "item")  # these stay in the JVM
    known = ascii.unionByName(names.filter(F.col("name").rlike("[^\\x00-\\x7F]")).select(form(F.col("name")).alias("term"), "item"))
    return known.filter((F.length("term") >= LEAST) & ~F.col("term").isin(*generic, ""))


def dictionary(names: DataFrame, name: str, item: str, generic: tuple[str, ...] = ()) -> DataFrame:
    """term and items (sorted, different) of all names that may be looked for."""
    return _known(names, name, item, generic).groupBy("term").agg(F.array_sort(F.collect_set("item")).alias("items"))  # the items of one name


def single(names: DataFrame, name: str, item: str, generic: tuple[str, ...] = ()) -> DataFrame:
    """term and item (null for a name of several) of all names that may be looked for; no row grows with a name's items."""
    same = F.min("item") == F.max("item")
    return _known(names, name, item, generic).groupBy("term").agg(F.when(same, F.min("item")).alias("item"))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0x9FB21C651E98DF25)
    return x ^ x >> np.uint64(32)


_BASE, _BEGINNING = 0x9E3779B97F4A7C15, np.uint64(0x5851F42D4C957F2D)
_SIGNS = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_powers: list[np.ndarray] = [np.ones(1, np.uint64)] * 2


def _keys(data: np.ndarray):
    """A function of places and lengths: a number for each such run of bytes, the same for equal runs."""
    if len(data) >= len(_powers[0]):
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            _powers[k] = np.cumprod(np.r_[np.uint64(1), np.full(2 * len(data), base, np.uint64)])
    sums = np.r_[np.uint64(0), np.cumsum(_SIGNS[data] * _powers[0][: len(data)])]
    return lambda at, length: _mixed((sums[at + length] - sums[at]) * _powers[1][at])


def _slots(keys: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The word of the filter that a key belongs to (words: a power of two, 2 ** 24 at most), and its four bits there."""
    bits = np.zeros(len(keys), np.uint64)
    for k in range(4):
        bits |= np.uint64(1) << (keys >> np.uint64(6 * k) & np.uint64(63))
    return (keys >> np.uint64(40) & np.uint64(words - 1)).astype(np.int64), bits


def _held(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at, bits = _slots(keys, len(words))
    return words[at] & bits == bits


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column without nulls, and where its strings begin and end."""
    column = column.cast(pa.large_string())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def _strings(data: np.ndarray, at: np.ndarray, length: np.ndarray) -> pa.Array:
    """Runs of bytes as strings."""
    ends = np.r_[0, np.cumsum(length)]
    picked = data[np.repeat(at - ends[:-1], length) + np.arange(ends[-1])]
    return pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(picked)]).cast(pa.string())


def _filter(names: DataFrame, laid_out: int) -> tuple[np.ndarray, list[int]]:
    """A Bloom filter of all names and of their beginnings (32 bits a name), and the different lengths of names in bytes."""
    words = 1 << max(0, (laid_out - 1).bit_length() - 1)

    def run(batches):
        for batch in batches:
            data, ends = _bytes(batch.column(0))
            key, at, length = _keys(data), ends[:-1], np.diff(ends)
            keys, least = [key(at, length)], BEGIN
            while len(long := np.flatnonzero(length >= least)):
                keys.append(np.unique(key(at[long], least) ^ _BEGINNING))
                least *= 2
            slot, bits = _slots(np.concatenate(keys), words)
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(bits.view(np.int64))], names=["slot", "bits"])

    rows = names.select("term").mapInArrow(run, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()  # a row a word
    out = np.zeros(words, np.uint64)
    out[rows.column("slot").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out, sorted(r["n"] for r in names.select(F.octet_length("term").alias("n")).distinct().collect())


def _pieces(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts of lines: each line's text, its place there, and where it begins and ends; without empty lines."""
    cuts = np.flatnonzero(data == 10)
    count = np.diff(np.searchsorted(cuts, ends)) + 1
    row, place = np.repeat(np.arange(len(count)), count), np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    begin, end = np.sort(np.r_[ends[:-1], cuts + 1]), np.sort(np.r_[ends[1:], cuts])
    full = end > begin
    return row[full], place[full], begin[full], end[full]


def _places(words: np.ndarray, lengths: list[int], data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where names may be in pieces, and their lengths: a whole piece, or a part of it."""
    key, at = _keys(data), np.flatnonzero(data != 10)
    left = np.repeat(end, end - begin) - at
    starts = data[at] & 0xC0 != 0x80
    at, left = at[starts], left[starts]
    finds, least = [], 0
    while lengths and lengths[-1] >= least and len(at):
        for n in (n for n in lengths if least <= n < max(BEGIN, 2 * least)):
            room = at[left >= n]
            found = room[_held(words, key(room, n))]
            finds.append((found, np.full(len(found), n)))
        least = max(BEGIN, 2 * least)
        at, left = at[left >= least], left[left >= least]
        begun = _held(words, key(at, least) ^ _BEGINNING)
        at, left = at[begun], left[begun]
    return tuple(np.concatenate(f) for f in zip(*finds, strict=True)) if finds else (np.empty(0, np.int64),) * 2


def _finds(shared):
    """Batches of (id, lines) as a row for each piece and what may be a name in it: id, place, piece, start, term; nulls for a piece without any."""

    def run(batches):
        words, lengths = shared.value
        for batch in batches:
            data, ends = _bytes(batch.column(1))
            row, place, begin, end = _pieces(data, ends)
            at, length = _places(words, lengths, data, begin, end)
            piece = np.searchsorted(begin, at, "right") - 1
            signs = np.r_[0, np.cumsum(data & 0xC0 != 0x80)]
            start = np.where(length == (end - begin)[piece], -1, signs[at] - signs[begin[piece]])
            kept = (start == -1) | (signs[at + length] - signs[at] >= LEAST_INSIDE)
            at, length, piece, start = at[kept], length[kept], piece[kept], start[kept]
            without = np.ones(len(begin), bool)
            without[piece] = False
            every, none = np.r_[piece, np.flatnonzero(without)], pa.nulls(int(without.sum()))
            columns = [
                batch.column(0).take(pa.array(row[every])),
                pa.array(place[every], pa.int32()),
                _strings(data, begin[every], (end - begin)[every]),
                pa.concat_arrays([pa.array(start, pa.int32()), none.cast(pa.int32())]),
                pa.concat_arrays([_strings(data, at, length), none.cast(pa.string())]),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "place", "piece", "start", "term"])

    return run


def spans(texts: DataFrame, key: str, text: str, names: DataFrame, groups: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """A row for each span, and one for each piece without any: id, place, piece, start (-1: the whole piece), term, item
    (its only one), method (exact, contained) and route (matched, group, ambiguous, excluded, unmatched).

    names: (term, item) as of `single`, or (term, items) as of `dictionary`; then the rows have items, too.
    groups: confirmed names of several items, in their compared form.  block: names that the filter is laid out for at
    most; with more of them more is looked up in vain."""
    spark = texts.sparkSession
    names = through_table(names, "names")
    one = F.col("item") if "item" in names.columns else F.when(F.size("items") == 1, F.get("items", F.lit(0)))
    shared = spark.sparkContext.broadcast(_filter(names, min(names.count(), block)))
    maybe = lines(texts, key, text).mapInArrow(_finds(shared), f"id {texts.schema[key].dataType.simpleString()}, place int, piece string, start int, term string")
    # What is not to be looked up is dealt by its text: no name has a blank.
    looked_up = F.coalesce("term", F.concat(F.lit(" "), F.xxhash64("id", "place").cast("string")))
    real = names.select(F.col("term").alias("looked_up"), one.alias("item"), F.lit(True).alias("real"))
    hit = F.struct("start", (-F.length("term")).alias("less"), "term", "item")
    met = maybe.withColumn("looked_up", looked_up).join(real, "looked_up", "left").select("id", "place", "piece", F.when(F.col("real"), hit).alias("hit"))
    found = met.repartition("id").groupBy("id", "place", "piece").agg(F.collect_list("hit").alias("hits"))  # the names in one piece
    hits = F.sort_array("hits")
    whole = F.get(hits, F.lit(0))["start"] == -1
    first = F.struct(F.lit(0).alias("end"), F.array().cast(found.schema["hits"].dataType).alias("taken"))
    took = lambda acc, h: F.when(h["start"] >= acc["end"], F.struct((h["start"] - h["less"]).alias("end"), F.concat(acc["taken"], F.array(h)).alias("taken"))).otherwise(acc)
    greedy = F.aggregate(hits, first, took, lambda acc: acc["taken"])
    taken = found.select("id", "place", "piece", F.explode_outer(F.when(F.size("hits") < 2, F.col("hits")).when(whole, F.slice(hits, 1, 1)).otherwise(greedy)).alias("h"))
    before = F.substr("piece", F.greatest(F.lit(1), F.col("h.start") + 1 - NEAR), F.least(F.lit(NEAR), F.col("h.start")))
    after = F.substr("piece", F.col("h.start") - F.col("h.less") + 1, F.lit(NEAR))
    absent = (F.col("h.start") >= 0) & (before.rlike(ABSENT_BEFORE) | after.rlike(ABSENT_AFTER))
    method = F.when(F.col("h.start") == -1, "exact").when(F.col("h.start") >= 0, "contained")
    term, item = F.col("h.term"), F.col("h.item")
    route = F.when(term.isNull(), "unmatched").when(absent, "excluded").when(item.isNotNull(), "matched").when(term.isin(*groups, ""), "group").otherwise("ambiguous")
    told = taken.select("id", "place", "piece", F.col("h.start").alias("start"), term.alias("term"), item.alias("item"), method.alias("method"), route.alias("route"))
    return told if "item" in names.columns else told.join(names, "term", "left")


def resolved(found: DataFrame) -> DataFrame:
    """From spans, one row for each text, route and thing: a matched item (its last exact name, else its first one), or
    another name; piece for what is unmatched."""
    at = F.struct("place", "start")
    thing = F.when(F.col("route") == "matched", F.col("item").cast("string")).when(F.col("route") == "unmatched", F.col("piece")).otherwise(F.col("term"))
    exact = F.max_by("term", F.when(F.col("method") == "exact", at))
    return found.groupBy("id", "route", thing.alias("thing")).agg(F.coalesce(exact, F.min_by("term", at)).alias("term"))
