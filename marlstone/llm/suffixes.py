"""Repeated passages by suffix arrays in a logarithmic index family.

Every byte covered by a window of MATCH bytes that also starts earlier (in a document of smaller id, or earlier in the
same one) is removed; windows never cross documents, and are judged on the input.

Which windows can meet.  A window's anchor is the GRAM bytes of least hash in it, the leftmost if tied: equal windows
have equal anchors at equal places.  A text is thus runs of windows with one anchor each, and a run's context is the
bytes its windows cover.  Runs go to shards by their anchor's hash.  Runs of equal context: all windows of all but the
earliest one are repeated.  Anchors that have one context are done; where an anchor has several, the earliest run of
each context is scanned.

The scan.  Contexts are cut out of the texts and dealt by anchor into shards of a bounded size.  In a shard, windows
come in batches, in order of document and place; each batch is sorted into a suffix array (starts in order of their
MATCH bytes), merge-scanned against itself and the levels of the family for equal windows, and what is new in it becomes
a level; levels of equal size are merged, two by two, so there are as many levels as the number of batches has binary
digits.

Hot anchors, those frequent in a sample of the documents (the sample only routes, it decides nothing), are spread over
all shards; each shard keeps its earliest run of each context, those meet in a grouped minimum, and their windows go to
shards by their own hash, so that no shard holds all contexts of one anchor.

Cases: a null text is empty; texts under MATCH bytes lose nothing; rows with a null id come after all others, as one
document; rows of one id are the same document, whose equal places are no repeats of each other, and repeated rows get the
same result; an empty table gives no rows; other columns come back unchanged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from marlstone.llm.runtime import free_names, ship_package, through_table, with_fields
from marlstone.llm.textbatch import _ODD, batches_of, mix, span_hashes, utf8

#: Bytes of a repeat and of an anchor.
MATCH, GRAM = 100, 32
#: Bytes of text for a shard of runs, bytes of contexts for a shard of windows, windows in a batch of the family.
RUN_SHARD, WINDOW_SHARD, BATCH = 6 << 20, 2 << 20, 1 << 16
#: Runs from which an anchor counts as hot (a millionth of all, if that is more), and the share of documents it is looked for in.
HOT, SAMPLED = 20_000, 64

_LAST_ID = (1 << 63) - 1


def runs(data: np.ndarray, offsets: np.ndarray, match: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of a batch of texts, each run of windows with one anchor: text, first window's start in the batch, windows, the
    anchor's hash and the context's."""
    n, windows = len(data), len(data) - match + 1
    if windows <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    eight = np.ndarray((n + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]).tobytes(), strides=(1,))
    grams = n - gram + 1
    h = np.zeros(grams, np.uint64)
    for at in (*range(0, gram - 8, 8), gram - 8):
        h ^= eight[at : at + grams]
        h *= _ODD
        h ^= h >> np.uint64(32)
    h *= _ODD
    low = np.uint64((1 << int(n).bit_length()) - 1)
    least, width, span = (h & ~low) | np.arange(grams, dtype=np.uint64), 1, match - gram + 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[:windows], least[span - width : span - width + windows])
    anchor = (least & low).astype(np.int64)
    crossing = np.zeros(n + 1, np.int32)
    np.add.at(crossing, np.maximum(offsets[1:-1] - match + 1, 0), 1)
    np.add.at(crossing, offsets[1:-1], -1)
    whole = np.cumsum(crossing)[:windows] == 0
    turn = np.ones(windows + 1, bool)
    turn[1:-1] = (anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1])
    start = np.flatnonzero(turn[:-1] & whole)
    end = np.flatnonzero(turn[1:] & whole) + 1
    return np.searchsorted(offsets, start, side="right") - 1, start, end - start, mix(h[anchor[start]]), span_hashes(data, start, end - 1 + match)


def later(doc: np.ndarray, start: np.ndarray, other_doc: np.ndarray, other_start: np.ndarray) -> np.ndarray:
    """Whether the first place comes after the second."""
    return (doc > other_doc) | ((doc == other_doc) & (start > other_start))


def _heads(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """For each place in `order` the first place with equal keys."""
    new = np.ones(len(order), bool)
    for k in keys:
        new[1:] &= k[order][1:] == k[order][:-1]
    new[1:] = ~new[1:]
    return np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))


def _joined(text: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows in order of (text, start): the rows that don't go on where the one before ends, and the windows from there."""
    new = np.ones(len(start), bool)
    new[1:] = (text[1:] != text[:-1]) | (start[1:] != start[:-1] + count[:-1])
    first = np.flatnonzero(new)
    return first, np.add.reduceat(count, first) if len(first) else count


_RUN = "shard long, k long, ctx long, doc long, th long, start int, n int"


def _runs_of(match: int, gram: int, shards: int, hot: np.ndarray):
    """Batches of (doc, th, text) as runs; runs whose context the batch has earlier are zones already: k and ctx null."""

    def run(batches):
        for batch in batches:
            docs, hashes = (batch.column(k).to_numpy() for k in (0, 1))
            for at, data, offsets in batches_of(utf8(batch.column(2))):
                text, begin, n, k, ctx = runs(data, offsets, match, gram)
                doc, th, start = docs[at + text], hashes[at + text], begin - offsets[text]
                order = np.lexsort((start, doc, ctx, k))
                head = order[_heads(order, k, ctx)]
                again = np.zeros(len(order), bool)
                again[order] = later(doc[order], start[order], doc[head], start[head])
                zone, size = _joined(text[again], start[again], n[again])
                zone = np.flatnonzero(again)[zone]
                kept = np.flatnonzero(~again)
                spread = np.where(_within(k[kept], hot), mix(doc[kept].astype(np.uint64) + k[kept]), k[kept])
                every = np.concatenate([kept, zone])
                known = np.arange(len(every)) < len(kept)
                shard = np.concatenate([spread, mix(doc[zone].astype(np.uint64))]) % np.uint64(shards)
                columns = [
                    pa.array(shard.astype(np.int64)), pa.array(k[every].view(np.int64), mask=~known), pa.array(ctx[every].view(np.int64), mask=~known),
                    pa.array(doc[every]), pa.array(th[every]), pa.array(start[every].astype(np.int32)), pa.array(np.concatenate([n[kept], size]).astype(np.int32)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _RUN.split(", ")])

    return run


def _within(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Whether each value is in the sorted array `among`."""
    if not len(among):
        return np.zeros(len(values), bool)
    at = np.searchsorted(among, values)
    return among[np.minimum(at, len(among) - 1)] == values


#: What became of a run: its windows are repeated; it is to be scanned; it has a hot anchor and is the earliest of its context in its shard.
ZONE, SCAN, HELD = 0, 1, 2
_JUDGED = "kind int, k long, ctx long, doc long, th long, start int, n int"


def _judged(hot: np.ndarray):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        zones = table.filter(table.column("k").is_null())
        open_ = table.filter(table.column("k").is_valid())
        k, ctx, doc, start = (open_.column(c).to_numpy() for c in ("k", "ctx", "doc", "start"))
        order = np.lexsort((start, doc, ctx, k))
        head = _heads(order, k, ctx)
        again = later(doc[order], start[order], doc[order][head], start[order][head])
        k_head = _heads(order, k)
        contexts = np.zeros(len(order), np.int64)
        np.add.at(contexts, k_head, head == np.arange(len(order)))
        kind = np.where(again, ZONE, np.where(_within(k[order].view(np.uint64), hot), HELD, np.where(contexts[k_head] > 1, SCAN, -1)))
        wanted = kind >= 0
        out = pa.concat_tables([zones, open_.take(pa.array(order[wanted]))]).drop_columns(["shard"])
        return out.add_column(0, "kind", pa.array(np.concatenate([np.full(zones.num_rows, ZONE), kind[wanted]]).astype(np.int32)))

    return run


_CONTEXT = "shard long, doc long, th long, start int, n int, bytes binary"


def _contexts_of(match: int, shards: int):
    """Batches of (doc, th, text, list of (start, n, k, hot)) as contexts; a hot anchor's windows one by one."""

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            listed = batch.column(3)
            of = np.repeat(np.arange(batch.num_rows), pa.compute.list_value_length(listed).to_numpy(zero_copy_only=False))
            start, n, k, hot = (c.to_numpy(zero_copy_only=False) for c in listed.flatten().flatten())
            times = np.where(hot, n, 1).astype(np.int64)
            each = np.repeat(np.arange(len(of)), times)
            step = np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times)
            begin, count = start[each] + step, np.where(hot[each], 1, n[each])
            text = of[each]
            from_, size = offsets[text] + begin, count + match - 1
            shard = np.where(hot[each], span_hashes(data, from_, from_ + size), mix(k[each].view(np.uint64))) % np.uint64(shards)
            for low in range(0, len(each), 1 << 14):
                some = slice(low, low + (1 << 14))
                ends = np.cumsum(size[some])
                place = np.repeat(from_[some] - (ends - size[some]), size[some]) + np.arange(ends[-1])
                raw = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[place]))])
                columns = [pa.array(shard[some].astype(np.int64)), batch.column(0).take(pa.array(text[some])), batch.column(1).take(pa.array(text[some])), pa.array(begin[some].astype(np.int32)), pa.array(count[some].astype(np.int32)), raw]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _CONTEXT.split(", ")])

    return run


class Family:
    """Suffix arrays of windows, in levels: a level of 2**p batches, all windows of all levels different."""

    def __init__(self, match: int):
        self.match, self.levels = match, []  # (p, windows in order, doc, start)

    def add(self, pool: np.ndarray, at: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Takes in a batch of windows pool[at:at + match], in order of (doc, start), all after those held; says which of
        them start earlier, too."""
        window = np.lib.stride_tricks.sliding_window_view(pool, self.match)[at].view(f"S{self.match}").ravel()
        order = np.argsort(window, kind="stable")
        window, doc, start = window[order], doc[order], start[order]
        new = np.ones(len(order), bool)
        new[1:] = window[1:] != window[:-1]
        head = np.flatnonzero(new)
        first_doc, first_start, fresh = doc[head], start[head], np.ones(len(head), bool)
        for _, held, its_doc, its_start in self.levels:
            place = np.minimum(np.searchsorted(held, window[head]), len(held) - 1)
            same = held[place] == window[head]
            first_doc, first_start = np.where(same, its_doc[place], first_doc), np.where(same, its_start[place], first_start)
            fresh &= ~same
        group = np.cumsum(new) - 1
        out = np.zeros(len(order), bool)
        out[order] = later(doc, start, first_doc[group], first_start[group])
        if fresh.any():
            self._push(0, window[head[fresh]], doc[head[fresh]], start[head[fresh]])
        return out

    def _push(self, power: int, *array: np.ndarray) -> None:
        while self.levels and self.levels[-1][0] == power:
            _, *below = self.levels.pop()
            both = [np.concatenate(pair) for pair in zip(below, array, strict=True)]
            order = np.argsort(both[0], kind="stable")  # a merge: two sorted runs
            power, array = power + 1, [b[order] for b in both]
        self.levels.append((power, *array))


_ZONE = "doc long, th long, start int, n int"


def _scanned(match: int, batch: int):
    """A shard's contexts through a family of its own: runs of repeated windows."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        doc, start, n = (table.column(c).to_numpy() for c in ("doc", "start", "n"))
        order = np.lexsort((start, doc))
        table = table.take(pa.array(order))
        doc, start, n = doc[order], start[order].astype(np.int64), n[order].astype(np.int64)
        raw = table.column("bytes").combine_chunks()
        raw = pa.concat_arrays(raw.chunks) if isinstance(raw, pa.ChunkedArray) else raw
        raw = raw.cast(pa.large_binary())
        offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
        pool = np.frombuffer(raw.buffers()[2], np.uint8)
        of = np.repeat(np.arange(len(n)), n)
        step = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        family, found = Family(match), np.zeros(len(of), bool)
        turn = np.lexsort((start[of] + step, doc[of]))  # runs of two texts with one id can interlace
        for low in range(0, len(of), batch):
            some = turn[low : low + batch]
            found[some] = family.add(pool, offsets[of[some]] + step[some], doc[of[some]], start[of[some]] + step[some])
        context, at = of[found], step[found]
        first, size = _joined(context, at, np.ones(len(at), np.int64))
        here = pa.array(context[first])
        return pa.table([table.column("doc").take(here), table.column("th").take(here), pa.array((start[context[first]] + at[first]).astype(np.int32)), pa.array(size.astype(np.int32))], names=[c.split()[0] for c in _ZONE.split(", ")])

    return run


def _cut(match: int, zone_at: int, text_at: int):
    """Batches of documents with a list of zones: the removed spans and the bytes that stay."""

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(text_at))
            spans, kept = [], []
            for k, zones in enumerate(batch.column(zone_at).to_pylist()):
                text, joined = data[offsets[k] : offsets[k + 1]].tobytes(), []
                for z in sorted((z["start"], z["n"]) for z in zones or ()):
                    low, high = z[0], z[0] + z[1] - 1 + match
                    if joined and low <= joined[-1][1]:
                        joined[-1][1] = max(joined[-1][1], high)
                    else:
                        joined.append([low, high])
                spans.append([{"start": a, "end": b} for a, b in joined])
                stay = [0, *(x for s in joined for x in s), len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(stay[::2], stay[1::2], strict=True)))
            columns = [c for k, c in enumerate(batch.columns) if k != zone_at]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            names = [c for k, c in enumerate(batch.schema.names) if k != zone_at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, kind), pa.array(kept, pa.binary())], names=[*names, "_spans", "_kept"])

    return run


def _hot_anchors(texts: DataFrame, runs_: float, match: int, gram: int) -> np.ndarray:
    """Sorted hashes of anchors that a sample of the documents shows to be frequent; a million at most."""
    least = max(HOT, runs_ / 1_000_000)
    sample = texts.filter(F.pmod(F.xxhash64(F.lit(5), "doc", "th"), F.lit(SAMPLED)) == 0).mapInArrow(_runs_of(match, gram, 1, np.zeros(0, np.uint64)), _RUN)
    counted = sample.groupBy("k").agg(F.count("*").alias("c")).filter((F.col("c") >= max(2, least / SAMPLED)) & F.col("k").isNotNull())
    return np.sort(np.array([r["k"] for r in counted.select("k").collect()], np.int64).view(np.uint64))


def zones(docs: DataFrame, match: int = MATCH, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """`docs` with its keys (doc, th), and the zones (doc, th, start, n): n windows from start on are repeats."""
    twice = not docs.groupBy("doc_id").agg(F.count("*").alias("c")).filter("c > 1").isEmpty()
    th = F.xxhash64("text") if twice else F.lit(0).cast("long")
    keyed = docs.select("*", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST_ID)).alias("doc"), th.alias("th"))
    texts = keyed.select("doc", "th", "text").filter(F.octet_length("text") >= match)
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    hot = _hot_anchors(texts, size * 2 / (match - gram + 2), match, gram)
    shards = int(max(1, size // RUN_SHARD))
    judged = texts.mapInArrow(_runs_of(match, gram, shards, hot), _RUN).groupBy("shard").applyInArrow(_judged(hot), _JUDGED)
    judged = through_table(judged, "runs")
    repeats = judged.filter(F.col("kind") == ZONE).select("doc", "th", "start", "n")
    scan = judged.filter(F.col("kind") == SCAN).select("doc", "th", F.struct("start", "n", "k", F.lit(False).alias("hot")).alias("r"))
    if len(hot):
        held = judged.filter(F.col("kind") == HELD)
        first = held.groupBy(F.col("k").alias("_k"), F.col("ctx").alias("_ctx")).agg(F.min(F.struct("doc", "start")).alias("first"))
        met = held.join(first, (F.col("k") == F.col("_k")) & (F.col("ctx") == F.col("_ctx")))
        mine = F.struct("doc", "start")
        repeats = repeats.unionByName(met.filter(mine > F.col("first")).select("doc", "th", "start", "n"))
        scan = scan.unionByName(met.filter(mine == F.col("first")).select("doc", "th", F.struct("start", "n", "k", F.lit(True).alias("hot")).alias("r")))
    volume = scan.agg(F.sum(F.when(F.col("r.hot"), F.col("r.n") * match).otherwise(F.col("r.n") + match - 1).cast("long"))).first()[0] or 0
    listed = scan.groupBy(F.col("doc").alias("_doc"), F.col("th").alias("_th")).agg(F.collect_list("r").alias("runs"))  # a document's own runs
    asked = texts.join(listed, (F.col("doc") == F.col("_doc")) & (F.col("th") == F.col("_th"))).select("doc", "th", "text", "runs")
    contexts = asked.mapInArrow(_contexts_of(match, int(max(1, volume // WINDOW_SHARD))), _CONTEXT)
    found = contexts.groupBy("shard").applyInArrow(_scanned(match, BATCH), _ZONE)
    return keyed, repeats.unionByName(found)


def dedup(docs: DataFrame, match: int = MATCH, gram: int = GRAM) -> DataFrame:
    """`docs` (doc_id, text) with two more columns: spans (the removed runs of bytes, array of start and end) and kept (the
    bytes that stay).  match is at least gram, gram at least 8."""
    ship_package(docs.sparkSession)
    at, key, spans, kept = free_names(docs, "zones_of_text", "key_of_text", "spans", "kept")
    plain = docs.select("doc_id", "text")
    _, found = zones(plain, match, gram)
    per = found.groupBy(F.col("doc").alias("_doc"), F.col("th").alias("_th")).agg(F.collect_list(F.struct("start", "n")).alias(at))  # a document's own zones
    per = through_table(per, "zones")
    twice = not per.filter("_th <> 0").isEmpty()
    mine = F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST_ID)).alias("_doc"), (F.xxhash64("text") if twice else F.lit(0).cast("long")).alias("_th"))
    joined = docs.withColumn(key, mine).join(per, (F.col(f"{key}._doc") == per["_doc"]) & (F.col(f"{key}._th") == per["_th"]), "left").select(*(f"`{c}`" for c in docs.columns), at)
    span = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))
    schema = with_fields(docs, **{spans: span, kept: BinaryType()})
    return joined.mapInArrow(_cut(match, len(docs.columns), docs.columns.index("text")), schema)
