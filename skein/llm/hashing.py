"""Words of whole texts as 64-bit hashes, in numpy over Arrow's own buffers.

A batch's text column is one byte buffer with offsets; words, their hashes and their texts are found
by array operations over blocks of it, so no Python string is made. Two words have the same hash with
a chance of about 2**-64 a pair; callers that must be exact compare at this width.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from .common import BLOCK_BYTES

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_POWERS: dict[str, np.ndarray] = {}

#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words that end at ASCII white space only.
SPACED = np.ones(256, dtype=bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
#: Bytes of words of lower-case letters, digits and whatever is not ASCII (after LOWER).
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


class Words(NamedTuple):
    """Words of a block of texts: byte spans in the block's buffer, hashes, and where each text's words begin."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # of each text, plus the number of words


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX[0]
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        n = max(n, BLOCK_BYTES + 1)
        for k, b in (("up", _BASE), ("down", _INVERSE)):
            a = np.full(n, b, dtype=np.uint64)
            a[0] = 1
            np.multiply.accumulate(a, out=a)
            _POWERS[k] = a
    return _POWERS["up"], _POWERS["down"]


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = SPACED, lower: bool = True) -> Words:
    """The words of the texts ``data[offsets[i]:offsets[i+1]]``; ``inside`` tells a word's bytes after lower-casing."""
    n = int(offsets[-1])
    data = data[:n]
    b = LOWER[data] if lower else data
    on = inside[b]
    edge = np.zeros(n + 1, dtype=bool)  # a word begins here, whatever stands before
    edge[offsets[:-1]] = True
    if n == 0:
        z = np.zeros(0, dtype=np.int64)
        return Words(z, z, z.astype(np.uint64), np.zeros(len(offsets), dtype=np.int64))
    begins = on.copy()
    begins[1:] &= ~on[:-1] | edge[1:n]
    ends = on.copy()
    ends[:-1] &= ~on[1:] | edge[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = _powers(n + 1)
    total = np.empty(n + 1, dtype=np.uint64)
    total[0] = 0
    v = b.astype(np.uint64)
    v += np.uint64(1)
    v *= up[:n]
    np.cumsum(v, out=total[1:])
    h = mix((total[end] - total[start]) * down[start])
    return Words(start, end, h, np.searchsorted(start, offsets))


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every run of ``k`` of the word hashes ``h``."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = h[:m].copy()
    for i in range(1, k):
        out *= _BASE
        out += h[i : i + m]
    return mix(out)


def shingle_sets(w: Words, k: int) -> Iterator[np.ndarray]:
    """Each text's sorted distinct ``k``-word shingles; a text of fewer words has its whole sequence as one."""
    every = shingles(w.hash, k)
    for a, b in zip(w.first[:-1], w.first[1:], strict=True):
        if b - a >= k:
            yield np.unique(every[a : b - k + 1])
        elif b > a:
            yield shingles(w.hash[a:b], int(b - a)) + np.uint64(b - a)
        else:
            yield np.zeros(0, dtype=np.uint64)


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Byte buffer and offsets of a string column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """The column in runs of rows of at most ``most`` bytes (or one longer text): from, to, bytes, offsets."""
    if not len(column):
        return
    data, off = texts(column)
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, side="right")) - 1)
        yield a, b, data[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b
