"""Media columns: a text's bytes kept losslessly as the coefficients of a baseline JPEG, and features read back from it.

Baseline JPEG is lossy in its samples but exact in its quantised coefficients, so the format's unit here is the
coefficient: each 8 x 8 block carries 64 payload bytes in zigzag order, as signed values with all quantisers 1.  They are
Huffman-coded as in any baseline file: categories and amplitudes, runs of zeros, end of block.  A restart marker after
every block keeps DC free of prediction.  `encode` gives the stored forms, `decode` parses markers, Huffman-decodes the
scans of a whole batch of files in numpy (every restart interval is a lane, all lanes advance a symbol at a time) and
gives payloads and DC-only luminance thumbnails.

Cases: a null or empty text is one block of zeros; equal texts give equal files; a broken file raises ValueError.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.runtime import ship_package

BLOCK = 64
#: Blocks along one side at most: a baseline frame has 16-bit sizes.
SIDE = 65535 // 8
#: Bytes of payload (or of stored files) that are coded together.
AT_ONCE = 1 << 18
_TAG = b"payload "
#: Run/size symbols from frequent to rare in text: no run with sizes 7 and 6, end of block, the other sizes, a run of 16
#: zeros, then any run of zeros; and how many of them have codes of 1, 2, ... 16 bits.
_SYMBOLS = [0x07, 0x06, 0x00, 0x05, 0x08, 0x04, 0x03, 0x02, 0x01, 0xF0, *(run << 4 | size for run in range(1, 16) for size in range(1, 9))]
_AC = ([0, 2, 2, 2, 1, 2, 1, 0, 0, 0, 0, 120, 0, 0, 0, 0], _SYMBOLS)
_DC = ([0, 2, 2, 2, 2, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0], [7, 6, 5, 8, 0, 4, 3, 2, 1])
_U = np.uint64


def _segment(marker: int, body: bytes) -> bytes:
    return bytes((0xFF, marker)) + (len(body) + 2).to_bytes(2, "big") + body


def padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % BLOCK or (0 if raw else BLOCK))


def _codes(table: tuple[list[int], list[int]]) -> dict[int, tuple[int, int]]:
    """symbol to (code, length), by the canonical assignment."""
    counts, symbols = table
    out, code, k = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[symbols[k]] = (code, length)
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _writing(table) -> tuple[np.ndarray, np.ndarray]:
    """Code and length of each of 256 symbols (length 0: none)."""
    code, length = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for s, (c, n) in _codes(table).items():
        code[s], length[s] = c, n
    return code, length


def _reading(table) -> np.ndarray:
    """For the next 16 bits: length << 8 | symbol of the code that they begin with; 0 for none."""
    out = np.zeros(1 << 16, np.int32)
    for s, (c, n) in _codes(table).items():
        out[c << (16 - n) : (c + 1) << (16 - n)] = n << 8 | s
    return out


#: Of each byte as a signed value: its category; and with its amplitude bits, what a coefficient without a run is coded as.
_SIGNED = np.arange(256) - 256 * (np.arange(256) > 127)
_SIZE = np.array([abs(int(v)).bit_length() for v in _SIGNED])
_AMPLITUDE = np.where(_SIGNED < 0, _SIGNED + (1 << _SIZE) - 1, _SIGNED)
_AC_CODE, _AC_BITS = _writing(_AC)
_DC_CODE, _DC_BITS = _writing(_DC)
_DC_VALUE, _DC_WIDTH = _DC_CODE[_SIZE] << _SIZE | _AMPLITUDE, _DC_BITS[_SIZE] + _SIZE
_AC_VALUE, _AC_WIDTH = (np.where(_SIZE > 0, x, 0) for x in (_AC_CODE[_SIZE] << _SIZE | _AMPLITUDE, _AC_BITS[_SIZE] + _SIZE))


def _tokens(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of blocks of signed values: each code with its amplitude bits (value, bits) and the block it belongs to, in order."""
    n, raw = len(values), values.view(np.uint8)
    value, bits = np.zeros((n, BLOCK + 1), np.int64), np.zeros((n, BLOCK + 1), np.int64)  # a place for each coefficient, and for the end
    value[:, 0], bits[:, 0] = _DC_VALUE[raw[:, 0]], _DC_WIDTH[raw[:, 0]]
    value[:, 1:BLOCK], bits[:, 1:BLOCK] = _AC_VALUE[raw[:, 1:]], _AC_WIDTH[raw[:, 1:]]  # as if no zeros stood before
    some = np.flatnonzero((raw[:, 1:] == 0).any(1))
    row, place = np.nonzero(raw[some, 1:])
    place += 1
    before = np.zeros(len(place), np.int64)
    before[1:] = np.where(row[1:] == row[:-1], place[:-1], 0)
    run = place - before - 1
    row, place, before, run = some[row[run > 0]], place[run > 0], before[run > 0], run[run > 0]
    s = _SIZE[raw[row, place]]
    symbol, rest = (run & 15) << 4 | s, (1 << s) - 1
    value[row, place], bits[row, place] = _AC_CODE[symbol] << s | _AC_VALUE[raw[row, place]] & rest, _AC_BITS[symbol] + s
    for k in (1, 2, 3):  # codes of 16 zeros, where the last of those zeros is
        far = run >= 16 * k
        value[row[far], before[far] + 16 * k], bits[row[far], before[far] + 16 * k] = _AC_CODE[0xF0], _AC_BITS[0xF0]
    open_ = raw[:, -1] == 0
    value[open_, BLOCK], bits[open_, BLOCK] = _AC_CODE[0], _AC_BITS[0]
    there = np.flatnonzero(bits)
    return value.reshape(-1)[there], bits.reshape(-1)[there], there // (BLOCK + 1)


def _scans(values: np.ndarray, first: np.ndarray) -> list[bytes]:
    """The entropy-coded segments of files whose blocks begin at `first` (n + 1)."""
    value, bits, owner = _tokens(values)
    n = len(values)
    total = np.bincount(owner, bits, n).astype(np.int64)
    words = -(-total // 32)
    start = np.cumsum(words) - words  # every block begins in a word of its own
    ahead = np.cumsum(bits) - bits
    ahead -= np.repeat(ahead[np.r_[True, owner[1:] != owner[:-1]]], np.bincount(owner, minlength=n))
    at = start[owner] * 32 + ahead
    wide = value.astype(_U) << (64 - (at & 31) - bits).astype(_U)
    many = int(words.sum()) + 1
    packed = np.bincount(at >> 5, (wide >> _U(32)).astype(np.float64), many) + np.bincount((at >> 5) + 1, (wide & _U(0xFFFFFFFF)).astype(np.float64), many)
    data = packed.astype(">u4").view(np.uint8)
    size = -(-total // 8)
    block = np.repeat(np.arange(n), size)
    within = np.arange(len(block)) - np.repeat(np.cumsum(size) - size, size)
    raw = data[start[block] * 4 + within]
    end = np.cumsum(size) - 1
    raw[end] |= ((1 << (size * 8 - total)) - 1).astype(np.uint8)  # filled up with ones
    index = np.arange(n) - np.repeat(first[:-1], np.diff(first))
    marked = np.ones(n, bool)
    marked[first[1:] - 1] = False
    stuffed = raw == 0xFF
    width = 1 + stuffed
    width[end[marked]] += 2
    pos = np.cumsum(width) - width
    out = np.zeros(int(width.sum()), np.uint8)
    out[pos] = raw
    mark = pos[end[marked]] + 1 + stuffed[end[marked]]
    out[mark], out[mark + 1] = 0xFF, 0xD0 + index[marked] % 8
    cuts = np.r_[pos[np.cumsum(size)[first[:-1]] - size[first[:-1]]], len(out)]
    return [out[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def encode(texts: list[bytes]) -> list[bytes]:
    """The JPEG file for each text's bytes."""
    shapes, parts = [], []
    for raw in texts:
        payload = padded(raw)
        n = len(payload) // BLOCK
        cols = int(np.ceil(np.sqrt(n)))
        rows = -(-n // cols)
        if cols > SIDE:
            raise ValueError("text too long for one baseline frame")
        shapes.append((len(payload), rows, cols))
        parts.append(payload + bytes(rows * cols * BLOCK - len(payload)))
    if not texts:
        return []
    values = np.frombuffer(b"".join(parts), np.int8).reshape(-1, BLOCK)
    first = np.cumsum([0, *(r * c for _, r, c in shapes)])
    tables = _segment(0xC4, b"".join(bytes([kind, *counts, *symbols]) for kind, (counts, symbols) in ((0x00, _DC), (0x10, _AC))))
    return [
        b"".join([
            b"\xff\xd8",
            _segment(0xFE, _TAG + str(size).encode()),
            _segment(0xDB, b"\0" + b"\1" * 64),
            _segment(0xC0, b"\x08" + (rows * 8).to_bytes(2, "big") + (cols * 8).to_bytes(2, "big") + b"\1\1\x11\0"),
            tables,
            _segment(0xDD, b"\0\1"),
            _segment(0xDA, b"\1\1\0\0\x3f\0"),
            scan,
            b"\xff\xd9",
        ])
        for (size, rows, cols), scan in zip(shapes, _scans(values, first), strict=True)
    ]


def markers(media: bytes) -> tuple[dict, bytes]:
    """What the segments before the scan say, and the scan's bytes without the end marker."""
    if media[:2] != b"\xff\xd8" or media[-2:] != b"\xff\xd9":
        raise ValueError("not a JPEG file")
    at, head = 2, {"tables": {}, "quant": {}, "restart": 0, "payload": None}
    while True:
        if media[at] != 0xFF:
            raise ValueError("marker expected")
        kind, size = media[at + 1], int.from_bytes(media[at + 2 : at + 4], "big")
        body, at = media[at + 4 : at + 2 + size], at + 2 + size
        if kind == 0xFE and body.startswith(_TAG):
            head["payload"] = int(body[len(_TAG) :])
        elif kind == 0xDB:
            while body:
                if body[0] >> 4:
                    raise ValueError("baseline quantisers have 8 bits")
                head["quant"][body[0] & 15], body = np.frombuffer(body[1:65], np.uint8).astype(np.int32), body[65:]
        elif kind == 0xC0:
            head |= {"height": int.from_bytes(body[1:3], "big"), "width": int.from_bytes(body[3:5], "big"), "components": body[5], "tq": body[8]}
        elif kind == 0xC4:
            while body:
                n = sum(body[1:17])
                head["tables"][body[0]], body = body[1 : 17 + n], body[17 + n :]
        elif kind == 0xDD:
            head["restart"] = int.from_bytes(body, "big")
        elif kind == 0xDA:
            if head["components"] != 1:
                raise ValueError("one luminance component is expected")
            head["dc"], head["ac"] = head["tables"][body[2] >> 4], head["tables"][16 + (body[2] & 15)]
            head["blocks"] = (head["height"] + 7) // 8 * ((head["width"] + 7) // 8)
            return head, media[at:-2]
        elif 0xC1 <= kind <= 0xCF:
            raise ValueError("only baseline frames are read")


_readers: dict[bytes, np.ndarray] = {}


def _reader(table: bytes) -> np.ndarray:
    if table not in _readers:
        if len(_readers) > 64:
            _readers.clear()
        _readers[table] = _reading((list(table[:16]), list(table[16:])))
    return _readers[table]


def coefficients(heads: list[dict], scans: list[bytes]) -> np.ndarray:
    """The quantised coefficients, in zigzag order, of all blocks of files that share their Huffman tables."""
    raw = np.frombuffer(b"".join(scans) + bytes(1), np.uint8)
    sizes = np.array([len(s) for s in scans])
    begin = np.cumsum(sizes) - sizes
    marks = np.flatnonzero(raw[:-1] == 0xFF)
    after = raw[marks + 1]
    restart = (after & 0xF8) == 0xD0
    if not (restart | (after == 0)).all():
        raise ValueError("marker inside the scan")
    drop = np.zeros(len(raw), bool)
    drop[marks + 1] = drop[marks[restart]] = True
    moved = np.arange(len(raw)) - np.cumsum(drop) + drop  # where each byte lies when these have been dropped
    data = raw[~drop]
    # Lanes: the restart intervals of all files, the bits where each begins and the blocks that it holds.
    lanes = np.sort(np.concatenate([begin, marks[restart] + 2]))
    of = np.searchsorted(begin, lanes, "right") - 1
    blocks, each = np.array([h["blocks"] for h in heads]), np.array([h["restart"] or h["blocks"] for h in heads])
    if (np.bincount(of, minlength=len(heads)) != -(-blocks // each)).any():
        raise ValueError("restart intervals don't match the frame")
    nth = np.arange(len(lanes)) - np.searchsorted(of, of)
    block = (np.cumsum(blocks) - blocks)[of] + nth * each[of]
    left = np.minimum(each[of], blocks[of] - nth * each[of])
    pos = moved[np.minimum(lanes, len(raw) - 1)] * 8
    wide = np.concatenate([data, np.full(8, 0xFF, np.uint8)]).astype(np.int64)
    window = wide[:-4] << 32 | wide[1:-3] << 24 | wide[2:-2] << 16 | wide[3:-1] << 8 | wide[4:]  # 40 bits from each byte on
    codes = np.concatenate([_reader(heads[0]["dc"]), _reader(heads[0]["ac"])])
    out = np.zeros(int(blocks.sum()) * BLOCK, np.int32)
    k, before = np.zeros(len(lanes), np.int64), np.zeros(len(lanes), np.int64)
    while len(pos):
        if pos.max() >= len(data) * 8:
            raise ValueError("the scan ends too early")
        bits, shift = window[pos >> 3], 40 - (pos & 7)
        code = codes[(bits >> (shift - 16) & 0xFFFF) | (k > 0) << 16].astype(np.int64)
        length, symbol = code >> 8, code & 255
        if (length == 0).any():
            raise ValueError("unknown Huffman code")
        size, run = symbol & 15, symbol >> 4
        amplitude = bits >> (shift - length - size) & (1 << size) - 1
        value = np.where(amplitude >> np.maximum(size - 1, 0) > 0, amplitude, amplitude - (1 << size) + 1)
        pos = pos + length + size
        dc = k == 0
        before = np.where(dc, before + value, before)
        k = k + np.where(dc, 0, run)
        here = (size > 0) | dc
        if (k[here] >= BLOCK).any():
            raise ValueError("coefficients beyond the block")
        out[block[here] * BLOCK + k[here]] = np.where(dc, before, value)[here]
        k = np.where(~dc & (symbol == 0), BLOCK, k + 1)
        full = k >= BLOCK
        block, left, k = block + full, left - full, np.where(full, 0, k)
        if full.any() and not left.all():
            live = left > 0
            pos, block, left, k, before = pos[live], block[live], left[live], k[live], before[live]
    return out.reshape(-1, BLOCK)


def decode(files: list[bytes]) -> list[tuple[bytes, np.ndarray, tuple[int, int]]]:
    """Of each file the payload read back, the DC-only luminance thumbnail (a sample for each block) and (width, height)."""
    parsed = [markers(x) for x in files]
    out: list = [None] * len(files)
    groups: dict = {}
    for i, (head, _) in enumerate(parsed):
        groups.setdefault((head["dc"], head["ac"]), []).append(i)
    for chosen in groups.values():
        heads = [parsed[i][0] for i in chosen]
        every = coefficients(heads, [parsed[i][1] for i in chosen])
        cuts = np.cumsum([0, *(h["blocks"] for h in heads)])
        for i, head, a, b in zip(chosen, heads, cuts[:-1], cuts[1:], strict=True):
            blocks = every[a:b]
            luma = np.clip(np.rint(blocks[:, 0] * head["quant"][head["tq"]][0] / 8 + 128), 0, 255).astype(np.uint8)
            shape = ((head["height"] + 7) // 8, (head["width"] + 7) // 8)
            out[i] = (blocks.astype(np.uint8).tobytes()[: head["payload"]], luma.reshape(shape), (head["width"], head["height"]))
    return out


def thumbnail_hash(luma: np.ndarray) -> str:
    """64 bits: which cells of the thumbnail's 8 x 8 reduction are brighter than their mean."""
    ys, xs = np.arange(9) * luma.shape[0] // 8, np.arange(9) * luma.shape[1] // 8
    sums = np.pad(luma.astype(np.int64).cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    lo_y, hi_y, lo_x, hi_x = np.minimum(ys[:-1], luma.shape[0] - 1), np.maximum(ys[1:], ys[:-1] + 1), np.minimum(xs[:-1], luma.shape[1] - 1), np.maximum(xs[1:], xs[:-1] + 1)
    hi_y, hi_x = np.minimum(hi_y, luma.shape[0]), np.minimum(hi_x, luma.shape[1])
    area = np.outer(hi_y - lo_y, hi_x - lo_x)
    cells = (sums[np.ix_(hi_y, hi_x)] - sums[np.ix_(lo_y, hi_x)] - sums[np.ix_(hi_y, lo_x)] + sums[np.ix_(lo_y, lo_x)]) / area
    return f"{int(''.join('01'[int(x)] for x in (cells > cells.mean()).reshape(-1)), 2):016x}"


def _together(values: list[bytes]):
    """Runs of values of about AT_ONCE bytes."""
    some, size = [], 0
    for x in values:
        some.append(x)
        size += len(x)
        if size >= AT_ONCE:
            yield some
            some, size = [], 0
    if some:
        yield some


def _store(batches):
    for batch in batches:
        raw = [(x or "").encode("utf-8", "surrogatepass") for x in batch.column(1).to_pylist()]
        at = 0
        for some in _together(raw):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(some)), pa.array([len(x) for x in some], pa.int64()), pa.array(encode(some), pa.binary())], names=["doc_id", "n_bytes", "media"])
            at += len(some)


_READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _read(batches):
    for batch in batches:
        rows = []
        for some in _together(batch.column(2).to_pylist()):
            for media, (payload, luma, (w, h)) in zip(some, decode(some), strict=True):
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), f"{w}x{h} {thumbnail_hash(luma)}"))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=[x.split()[0] for x in _READ.split(", ")])


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the stored file of every document's whole text; other columns are not read."""
    ship_package(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_store, "doc_id long, n_bytes long, media binary")


def read_media(media: DataFrame) -> DataFrame:
    """Dimensions, thumbnail hash and digests, read back from the stored files."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_read, _READ)
