import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_equals_the_library(library, texts):
    for text, (ids, raw) in zip(texts, bpe.codec(PATH, P.PATTERN).texts(texts), strict=True):
        assert ids == ",".join(map(str, library.encode_ordinary(text)))
        assert raw == text.encode()


@pytest.mark.parametrize("text", ["x" * 5000, "ab" * 900, "aaab" * 200 + "a" * 333, "<|endoftext|> it's  two\n\n spaces ", "été naïve ñandú" * 30])
def test_long_pieces(library, text):
    ((ids, raw),) = bpe.codec(PATH, P.PATTERN).texts([text])
    assert ids == ",".join(map(str, library.encode_ordinary(text))) and raw == text.encode()


@pytest.mark.parametrize("n", [3000, 100_000])
def test_one_long_piece_of_random_letters(library, n):
    rng = random.Random(n)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    ((ids, raw),) = bpe.codec(PATH, P.PATTERN).texts([text])
    assert ids == ",".join(map(str, library.encode_ordinary(text))) and raw == text.encode()


def test_operator(spark, library):
    rows = [(1, "Hello there, world", 9), (2, None, 1), (3, "", 2), (3, "", 2), (None, "déjà vu " * 5000, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = bpe.encode_decode(docs, PATH, P.PATTERN, keep=True).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(t or "" for d, t, _ in rows if d == r.doc_id)
        ids = library.encode_ordinary(text)
        assert r.ids == ids and r.n_tokens == len(ids) and bytes(r.decoded) == text.encode()
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert bpe.encode_decode(docs.limit(0), PATH, P.PATTERN).count() == 0
