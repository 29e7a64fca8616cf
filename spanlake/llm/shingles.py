"""Word shingles of Arrow text batches as 64-bit hashes, computed batch-wise in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from spanlake.llm.common import doc_ranges, utf8

#: Words are runs of ASCII letters (lower-cased), digits and non-ASCII bytes.
_FOLD = np.array([b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0
                  for b in range(256)], np.uint8)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE), np.full(n, _INVERSE)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, number of words of every document)."""
    n = len(data)
    body = _FOLD[data]
    word = np.zeros(n + 1, bool)
    word[:n] = body != 0
    before = np.zeros(n + 1, bool)
    before[1:] = word[:-1]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(word & (~before | cut))
    ends = np.flatnonzero(before & (~word | cut))
    size = max(1 << 21, 1 << int(n + 1).bit_length())
    up, down = _powers(size)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(body.astype(np.uint64) * up[:n], out=total[1:])
    h = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    per_doc = np.diff(np.searchsorted(starts, offsets))
    return h, per_doc


def shingle_sets(col, width: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text of an Arrow column, in order.  A text
    of fewer than ``width`` words is one shingle, one without words none."""
    data, offsets = utf8(col)
    for i, j in doc_ranges(offsets):
        h, per_doc = word_hashes(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
        first = np.concatenate([[0], np.cumsum(per_doc)])
        rolled = np.zeros(max(len(h) - width + 1, 0), np.uint64)
        for k in range(width):
            rolled = rolled * _STEP + h[k:k + len(rolled)]
        rolled = mix(rolled)
        for d in range(j - i):
            a, n = first[d], per_doc[d]
            if n >= width:
                yield np.unique(rolled[a:a + n - width + 1])
            elif n:
                s = np.uint64(n)
                with np.errstate(over="ignore"):
                    for x in h[a:a + n]:
                        s = s * _STEP + x
                yield mix(np.array([s], np.uint64))
            else:
                yield np.zeros(0, np.uint64)
