"""Best-fit packing of token sequences into fixed windows, with several capacities (vector bin packing).

Documents are tokenised where they lie; the pieces (lengths only, no ids) are dealt into shards of bounded expected
size, and each shard is packed on its own in order of falling length.  A sequence has three capacities: tokens, pieces,
and attention cost (a piece of b blocks of `block` tokens costs b * b, as block-wise attention within documents does).
A piece goes to the open sequence where all three hold and the weighted norm of what would remain is least, of equal
ones to that opened first; where none fits it opens a new one.

Cases: a null or empty text is one piece holding the end token; a document of no more than `window` tokens is never cut;
of a longer one the first piece may be shorter and the others are full; repeated rows are packed like any others, and
dealt to different shards.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.runtime import ship_package, through_table

#: Pieces that one shard is meant to hold; pieces that one sequence holds at most (a sequence's attention cost alone would
#: let in 64 short ones, so this is a capacity of its own); tokens in a block of attention.
SHARD, MOST, BLOCK = 4096, 48, 128
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _byte_alphabet() -> dict[str, int]:
    """The characters that stand for the 256 bytes in a byte-level vocabulary: printable ones for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def load_encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """The byte-level BPE of a tokenizers JSON file, without special tokens, for the faster library of the same ids.

    Needs a file whose merges are in the order of their outcomes' ids; another raises ValueError."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    alphabet = _byte_alphabet()
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [model["vocab"][a + b] for a, b in merges]
    if made != sorted(made):
        raise ValueError("merges aren't in the order of their ids")
    tokens = [c for c in alphabet] + [a + b for a, b in merges]
    ranks = {bytes(alphabet[c] for c in t): model["vocab"][t] for t in tokens}
    return tiktoken.Encoding("byte_level", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


_encodings: dict[tuple[str, str], tiktoken.Encoding] = {}


def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    if (path, pattern) not in _encodings:
        _encodings[path, pattern] = load_encoding(path, pattern)
    return _encodings[path, pattern]


def load_added(path: str) -> dict[str, int]:
    """The added tokens of a tokenizers JSON file, which the library matches inside text. Those that take in neighbouring
    spaces or must be whole words, and a file that normalises text, raise ValueError."""
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    added = whole.get("added_tokens") or []
    if whole.get("normalizer") or any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens that aren't matched as they stand")
    return {t["content"]: t["id"] for t in added}


_added: dict[str, dict[str, int]] = {}


def ids_of(text: str, tool: tiktoken.Encoding, added: dict[str, int]) -> list[int]:
    """The ids of a text; where `added` tokens stand (the longest at a place, from the left) it is split and has theirs."""
    if not any(t in text for t in added):
        return tool.encode_ordinary(text)
    parts = re.split(f"({'|'.join(re.escape(t) for t in sorted(added, key=len, reverse=True))})", text)
    return [i for k, part in enumerate(parts) for i in ([added[part]] if k % 2 else tool.encode_ordinary(part))]


def pieces(docs: DataFrame, path: str, pattern: str, window: int = 1024, end: int = 2, keep_ids: bool = False, added_tokens: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece (keep_ids: also the ids). Other columns are not read.

    added_tokens: the file's added tokens have their own ids where they stand in a text, as in `tokenizers` by default;
    else they are text like any other, as with its encode_special_tokens."""
    ship_package(docs.sparkSession)
    names = [x.split()[0] for x in _PIECE.split(", ")] + ["ids"] * keep_ids

    def cut(batches):
        tool = encoding(path, pattern)
        if added_tokens and path not in _added:
            _added[path] = load_added(path)
        added = _added[path] if added_tokens else {}
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):  # one text at a time as a Python string
                ids = np.array([*ids_of(text.as_py() or "", tool, added), end], "<u4")
                first = len(ids) % window or window
                for k, at in enumerate([0, *range(first, len(ids), window)] if len(ids) > window else [0]):
                    part = ids[at : first + k * window] if len(ids) > window else ids
                    rows.append((doc_id, k, at, len(part), zlib.crc32(part.tobytes()), *([part.astype(np.int32)] if keep_ids else [])))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(len(names))], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, _PIECE + ", ids array<int>" * keep_ids)


def fit(lengths: np.ndarray, capacity: tuple[int, int, int], weights: tuple[float, float, float], block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, lengths falling; capacity: tokens, pieces and blocks' cost."""
    full = np.array(capacity, np.float64)
    scale = np.asarray(weights, np.float64) / full**2
    n = len(lengths)
    where, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    residual, name, opened = np.zeros((n, 3)), np.zeros(n, np.int64), 0  # open sequences come first, in order of opening
    made = 0
    for k in range(n):
        length = int(lengths[k])
        size = np.array([length, 1, (-(-length // block)) ** 2], np.float64)
        left = residual[:opened] - size
        fits = (left >= 0).all(1)
        if fits.any():
            b = int(np.where(fits, (left * left) @ scale, np.inf).argmin())
        else:
            b, opened = opened, opened + 1
            residual[b], name[b], made = full, made, made + 1
        where[k], offset[k] = name[b], capacity[0] - int(residual[b, 0])
        residual[b] -= size
        if k % 256 == 255:  # sequences that can't take the shortest piece any more are closed
            live = np.flatnonzero((residual[:opened, 0] >= lengths[-1]) & (residual[:opened, 1:] > 0).all(1))
            residual[: len(live)], name[: len(live)], opened = residual[live], name[live], len(live)
    return where, offset


def pack(docs: DataFrame, path: str, pattern: str, window: int = 1024, end: int = 2, most: int = MOST, most_cost: int | None = None, weights: tuple[float, float, float] = (1.0, 0.01, 0.05), block: int = BLOCK, added_tokens: bool = False) -> DataFrame:
    """Every piece with its sequence_id and offset (added_tokens: see `pieces`).

    A sequence holds `most` pieces and blocks of `most_cost` at most; the latter is by default what one full piece costs,
    the least that can be (less raises ValueError)."""
    least = (-(-window // block)) ** 2
    most_cost = least if most_cost is None else most_cost
    if most_cost < least or most < 1:
        raise ValueError("a full piece would exceed the capacity of a sequence")
    cut = through_table(pieces(docs, path, pattern, window, end, added_tokens=added_tokens), "pieces")
    shards = max(1, -(-cut.count() // SHARD))

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.drop_columns(["shard"]).sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        where, offset = fit(rows.column("length").to_numpy(), (window, most, most_cost), weights, block)
        return rows.append_column("sequence_id", pa.array(where + (key[0].as_py() << 32))).append_column("offset", pa.array(offset))

    # The place in the written table tells repeated rows apart.
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInArrow(run, _PIECE + ", sequence_id long, offset long")
