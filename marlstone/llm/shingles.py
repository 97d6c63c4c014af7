"""Word-shingle sets of whole texts, as sorted 64-bit hashes, computed with numpy over batches."""

from __future__ import annotations

import numpy as np

from marlstone.llm.textbatch import lower_ascii, mix, span_hashes, spans

_SPACE = [32, *range(9, 14)]
WORD = np.ones(256, bool)
WORD[_SPACE] = False
_ROW = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93)]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int):
    """For each text, the sorted distinct hashes of its `width`-word shingles; of fewer words, one of them all."""
    data = lower_ascii(data)
    starts, ends, first = spans(data, offsets, WORD)
    h = span_hashes(data, starts, ends)
    n = len(h)
    rolled = np.zeros(max(0, n - width + 1), np.uint64)
    for k in range(width):
        rolled += h[k : k + len(rolled)] * (_ROW[k % len(_ROW)] + np.uint64(2 * k))
    rolled = mix(rolled)
    for s, e in zip(first[:-1], first[1:], strict=True):
        words = e - s
        if words >= width:
            yield np.unique(rolled[s : e - width + 1])
        elif words:
            whole = np.zeros(1, np.uint64)
            for k in range(words):
                whole += h[s + k : s + k + 1] * (_ROW[k % len(_ROW)] + np.uint64(2 * k))
            yield mix(whole + np.array([words], np.uint64) * np.uint64(0x2545F4914F6CDD1D))
        else:
            yield np.zeros(0, np.uint64)
