"""Byte-level BPE as DuckDB recursive queries, run inside Spark partitions.

Texts are cut by the vocabulary's pattern; each distinct piece that a worker has not met lately becomes token-position
rows in DuckDB, which a recursive query joins to the merge table, contracting each piece's leftmost pair of least rank
until none is left.  An ordered aggregation over the ids gives the decoded bytes.  A text's ids are those of its pieces
in order.  Equal to the tiktoken library's ordinary encoding.

A piece over LONG bytes contracts all occurrences of its least pair in one round, which gives the same ids, as a merge's
outcome outranks its parts; and its query ends after so many rounds that they hold ROWS rows at most (or one round), the
last round's tokens being the next query's first, so memory doesn't grow with the rounds.

Cases: a null or empty text has no ids (and decodes to nothing); a piece may be as long as the text.
"""

from __future__ import annotations

import base64
import hashlib

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.runtime import ship_package

#: Pieces longer than this contract every occurrence of the least pair in a round.
LONG = 200
#: Rows that one recursive query of a long piece may gather (expected).
ROWS = 1_500_000
#: Pieces that one worker keeps encoded; when full it starts anew. A matter of speed only.
CACHE = 700_000
#: Pieces that one DuckDB statement encodes, and bytes of text that are looked at together.
CHUNK, AT_ONCE = 30_000, 4 << 20

_ENCODE = """
WITH RECURSIVE pieces(step, w, ids) AS (
    SELECT 0, w, ids FROM piece_lists
  UNION ALL (
    WITH tok AS (SELECT w, unnest(ids) AS a, unnest(ids[2:]) AS b, generate_subscripts(ids, 1) AS pos FROM pieces),
    least AS (SELECT w, min((m.id::BIGINT << 20) + pos) AS key FROM tok JOIN merges m USING (a, b) GROUP BY w)
    SELECT step + 1, w, ids[:(key & 1048575) - 1] || [(key >> 20)::INTEGER] || ids[(key & 1048575) + 2:]
    FROM pieces JOIN least USING (w)
  )
)
SELECT w, arg_min(ids, len(ids)) AS ids FROM pieces GROUP BY w  -- a round makes one token less
"""

_ENCODE_LONG = """
WITH RECURSIVE tok(step, pos, id) AS (
    SELECT 0, pos, id FROM piece_bytes
  UNION ALL (
    WITH seen AS (SELECT *, lead(id) OVER (ORDER BY pos) AS nxt, row_number() OVER (ORDER BY pos) AS rn FROM tok WHERE step < {rounds}),
    ranked AS (SELECT seen.*, m.id AS made FROM seen LEFT JOIN merges m ON m.a = seen.id AND m.b = seen.nxt),
    least AS (SELECT min(made) AS made FROM ranked HAVING min(made) IS NOT NULL),
    hits AS (SELECT rn, rn - row_number() OVER (ORDER BY rn) AS run FROM ranked JOIN least USING (made)),
    taken AS (SELECT rn FROM (SELECT rn, row_number() OVER (PARTITION BY run ORDER BY rn) AS k FROM hits) WHERE k % 2 = 1)
    SELECT step + 1, pos, CASE WHEN t.rn IS NOT NULL THEN least.made ELSE id END
    FROM ranked r CROSS JOIN least LEFT JOIN taken t ON r.rn = t.rn WHERE r.rn - 1 NOT IN (SELECT rn FROM taken)
  )
)
SELECT step, pos, id FROM tok WHERE step = (SELECT max(step) FROM tok)
"""

_DECODE = """
SELECT w, array_to_string(ids, ',') AS ids, hexed
FROM id_lists JOIN (
    SELECT w, string_agg(v.hexed, '' ORDER BY pos) AS hexed
    FROM (SELECT w, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM id_lists) JOIN vocabulary v USING (id) GROUP BY w
) USING (w)
ORDER BY w
"""


class Codec:
    """The vocabulary and merge table of one rank file, in an in-memory DuckDB of one thread."""

    def __init__(self, path: str, pattern: str, memory: str = "300MB"):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.pattern = regex.compile(pattern)
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": memory, "temp_directory": ""})
        a, b, r = (pa.array(x, pa.int32()) for x in zip(*pairs, strict=True))
        self._table("merges", pa.table({"a": a, "b": b, "id": r}))
        self._table("vocabulary", pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "hexed": [x.hex() for x in ranks]}))
        self.known: dict[str, tuple[str, bytes]] = {}

    def _table(self, name: str, rows: pa.Table) -> None:
        self.con.register("incoming", rows)
        self.con.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM incoming")
        self.con.unregister("incoming")

    def pieces(self, pieces: list[bytes]):
        """For each piece of at least one byte, which isn't cut any further, its ids as decimals and their decoding."""
        short = [k for k, x in enumerate(pieces) if len(x) <= LONG]
        for i in range(0, len(short), CHUNK):
            chosen = short[i : i + CHUNK]
            self._lists([pieces[k] for k in chosen])
            self.con.execute(f"CREATE OR REPLACE TABLE id_lists AS {_ENCODE}")
            yield from self._decoded(chosen)
        for k, x in enumerate(pieces):
            if len(x) > LONG:
                self._bytes([x])
                step = rounds = 1
                while step == rounds:  # the query ended for its rounds, not for want of pairs
                    n = self.con.execute("SELECT count(*) FROM piece_bytes").fetchone()[0]
                    rounds = max(1, ROWS // n)
                    self.con.execute(f"CREATE OR REPLACE TABLE tokens AS {_ENCODE_LONG.format(rounds=rounds)}")
                    step = self.con.execute("SELECT any_value(step) FROM tokens").fetchone()[0]
                    self.con.execute("CREATE OR REPLACE TABLE piece_bytes AS SELECT 0 AS w, pos, id FROM tokens")
                self.con.execute("CREATE OR REPLACE TABLE id_lists AS SELECT 0 AS w, list(id ORDER BY pos) AS ids FROM tokens")
                yield from self._decoded([k])

    def _lists(self, pieces: list[bytes]) -> None:
        ends = np.cumsum([0, *map(len, pieces)]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]))
        self._table("piece_lists", pa.table({"w": np.arange(len(pieces), dtype=np.int32), "ids": ids}))

    def _bytes(self, pieces: list[bytes]) -> None:
        sizes = np.array([len(x) for x in pieces])
        w = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes)
        pos = np.arange(len(w), dtype=np.int32) - np.repeat(np.cumsum(sizes) - sizes, sizes).astype(np.int32)
        self._table("piece_bytes", pa.table({"w": w, "pos": pos, "id": self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]}))

    def _decoded(self, chosen: list[int]):
        for w, decimals, hexed in self.con.execute(_DECODE).fetchall():
            yield chosen[w], decimals, bytes.fromhex(hexed)

    def learn(self, pieces: set[str]) -> None:
        new = sorted(pieces - self.known.keys())
        if len(self.known) + len(new) > CACHE:
            self.known, new = {}, sorted(pieces)
        for i in range(0, len(new), CHUNK):
            some = new[i : i + CHUNK]
            for k, ids, raw in self.pieces([x.encode() for x in some]):
                self.known[some[k]] = (ids, raw)

    def texts(self, texts: list[str]):
        """For each text, its ids as decimals joined by commas, and their decoding."""
        at = 0
        while at < len(texts):
            cut, size, to = [], 0, at
            while to < len(texts) and (size < AT_ONCE or to == at):
                cut.append(self.pattern.findall(texts[to]))
                size, to = size + len(texts[to]), to + 1
            self.learn(set().union(*cut))
            for pieces in cut:
                found = [self.known[x] for x in pieces]
                yield ",".join([x for x, _ in found]), b"".join([x for _, x in found])
            at = to


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """This worker's codec for the file."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def encode_decode(docs: DataFrame, path: str, pattern: str, keep: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text; keep: also ids (array) and decoded (binary).

    `path` is a rank file that every executor has at the same place. Other columns are not read."""
    ship_package(docs.sparkSession)

    def run(batches):
        tool = codec(path, pattern)
        for batch in batches:
            rows = []
            for ids, raw in tool.texts(batch.column(1).fill_null("").to_pylist()):
                rows.append((ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(raw).hexdigest(), *([[int(x) for x in ids.split(",")] if ids else [], raw] if keep else [])))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.binary()]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: 4 + 2 * keep]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], kinds[k]) for k in range(len(names) - 1))], names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded binary" * keep
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
