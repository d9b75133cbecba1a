"""Words of many texts at once, as numpy arrays.

A word is a run of non-space characters; space is one of blank, tab, line feed, carriage
return and form feed.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

from .sentencepiece_bpe import buffers

_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0D, 0x0C]] = True


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(1 << bits, base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p))
    return out[0], out[1]


def split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all words in turn the 64-bit hash, the first byte and the end; where each text's
    words begin (one more than texts); and the bytes. Nulls have no word."""
    off, data, _ = buffers(texts.fill_null(""))
    lo, hi = int(off[0]), int(off[-1])
    view, off = data[lo:hi], off.astype(np.int64) - lo
    if not len(view):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(off), np.int64), view
    word = ~_SPACE[view]
    edge = np.zeros(len(view) + 1, bool)
    edge[off] = True
    begins = word.copy()
    begins[1:] &= ~word[:-1] | edge[1:-1]
    ends = word.copy()
    ends[:-1] &= ~word[1:] | edge[1:-1]
    s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    power, inverse = _powers(max(21, int(len(view)).bit_length()))
    total = np.zeros(len(view) + 1, np.uint64)
    np.cumsum((view.astype(np.uint64) + np.uint64(1)) * power[: len(view)], out=total[1:])
    h = scramble((total[e] - total[s]) * inverse[s] ^ ((e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    return h, s, e, np.searchsorted(s, off), view
