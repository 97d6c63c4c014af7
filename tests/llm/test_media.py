import hashlib
import math
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.llm import media


def bit_by_bit(stored):
    """Blocks of one file by a decoder that reads one bit at a time, as the standard describes it."""
    head, scan = media.markers(stored)
    data, at = bytearray(), 0
    parts = []
    while at < len(scan):
        if scan[at] == 0xFF:
            if scan[at + 1]:
                parts.append(bytes(data))
                data = bytearray()
            else:
                data.append(0xFF)
            at += 2
        else:
            data.append(scan[at])
            at += 1
    parts.append(bytes(data))
    books = []
    for table in (head["dc"], head["ac"]):
        book, code, k = {}, 0, 16
        for length in range(1, 17):
            for _ in range(table[length - 1]):
                book[f"{code:0{length}b}"] = table[k]
                code, k = code + 1, k + 1
            code *= 2
        books.append(book)
    blocks = []
    for part in parts:
        bits, here = "".join(f"{b:08b}" for b in part), 0

        def symbol(book):
            nonlocal here
            to = here + 1
            while bits[here:to] not in book:
                to += 1
            s, here = book[bits[here:to]], to
            return s

        def amplitude(size):
            nonlocal here
            v, here = bits[here : here + size], here + size
            return 0 if not size else int(v, 2) if v[0] == "1" else int(v, 2) - 2**size + 1

        block = [0] * 64
        block[0] = amplitude(symbol(books[0]))
        k = 1
        while k < 64:
            s = symbol(books[1])
            if s == 0:
                break
            k += s >> 4
            block[k] = amplitude(s & 15)
            k += 1
        blocks.append(block)
    return blocks


def average_sample(block):
    """The mean of the 64 samples that an inverse DCT of the whole block gives."""
    zigzag = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    c = np.zeros((8, 8))
    for v, (y, x) in zip(block, zigzag, strict=True):
        c[y, x] = v
    basis = np.array([[math.cos((2 * i + 1) * u * math.pi / 16) * (math.sqrt(0.125) if u == 0 else 0.5) for i in range(8)] for u in range(8)])
    return (basis.T @ c @ basis + 128).mean()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.binary(max_size=700), st.lists(st.sampled_from([0, 0, 0, 1, 255, 128]), max_size=400).map(bytes)), min_size=1, max_size=4))
def test_round_trip(texts):
    stored = media.encode(texts)
    for raw, file, (payload, luma, (w, h)) in zip(texts, stored, media.decode(stored), strict=True):
        assert payload == media.padded(raw) and len(payload) % 64 == 0 and payload
        assert luma.shape == (h // 8, w // 8)
        assert file[:2] == b"\xff\xd8" and file[-2:] == b"\xff\xd9"
        assert media.encode([raw]) == [file]


def test_equals_bit_by_bit_decoding_and_whole_inverse_transforms():
    texts = [bytes(range(256)) * 3 + b"\xff" * 70, b"plain text of a page, \xc3\xa9 " * 40, b"", bytes(100) + b"x" + bytes(40)]
    for file, (payload, luma, _) in zip(media.encode(texts), media.decode(media.encode(texts)), strict=True):
        blocks = bit_by_bit(file)
        assert np.array(blocks).astype(np.uint8).tobytes()[: len(payload)] == payload
        assert all(abs(min(255, max(0, average_sample(b))) - x) <= 0.5 + 1e-6 for b, x in zip(blocks, luma.reshape(-1).tolist(), strict=True))


def test_hash_equals_cell_means():
    luma = np.random.default_rng(3).integers(0, 256, (19, 24)).astype(np.uint8)
    ys, xs = [k * 19 // 8 for k in range(9)], [k * 24 // 8 for k in range(9)]
    cells = np.array([[luma[ys[i] : max(ys[i + 1], ys[i] + 1), xs[j] : max(xs[j + 1], xs[j] + 1)].mean() for j in range(8)] for i in range(8)])
    assert media.thumbnail_hash(luma) == f"{int(''.join(str(int(v > cells.mean())) for v in cells.reshape(-1)), 2):016x}"


def test_other_restart_intervals_and_predicted_dc():
    """A scan without restarts, whose DC values are differences: two blocks of DC 5 and 7, one AC of -3 after 17 zeros."""
    book = lambda table: {s: f"{c:0{n}b}" for s, (c, n) in media._codes(table).items()}
    dc, ac = book(media._DC), book(media._AC)
    bits = dc[3] + "101" + ac[0xF0] + ac[0x12] + "00" + ac[0] + dc[2] + "10" + ac[0]
    bits += "1" * (-len(bits) % 8)
    scan = bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8))
    table = lambda t: bytes([*t[0], *t[1]])
    got = media.coefficients([{"dc": table(media._DC), "ac": table(media._AC), "blocks": 2, "restart": 0}], [scan.replace(b"\xff", b"\xff\0")])
    assert got[0, 0] == 5 and got[0, 18] == -3 and got[1, 0] == 7 and np.count_nonzero(got) == 3


def test_broken_files_are_refused():
    good = media.encode([b"some text that is long enough to be cut " * 9])[0]
    for bad in (b"\xff\xd8 nothing", good[:-40] + b"\xff\xd9", good[:-9] + b"\xff\xff\xff\xff\xff\xff\xff\xff\xd9"):
        with pytest.raises(ValueError):
            media.decode([bad])


def test_query_columns(spark):
    rows = [(1, "a", 5), (2, None, 6), (3, "", 7), (4, "é" * 70, 8), (5, "a", 9), (None, "x" * 300_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_bytes int")
    got = {r.doc_id: r for r in media.read_media(media.to_media(docs)).collect()}
    for doc_id, text, _ in rows:
        raw = (text or "").encode()
        payload = media.padded(raw)
        r = got[doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert got[1].media_sha256 == got[5].media_sha256 and got[1].feature == got[5].feature
    assert media.read_media(media.to_media(docs.limit(0))).count() == 0
