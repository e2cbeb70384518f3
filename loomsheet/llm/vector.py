"""Words, hashes and shingles of whole Arrow batches of texts, in numpy.

A batch's texts lie in one byte buffer. Words are found and hashed there
without making a Python object per word. Hash tables are drawn from a fixed
seed, so every worker agrees.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Bytes of words that are hashed at a time.
CHUNK = 1 << 20
_DEPTH = 32
_rng = np.random.default_rng(20240607)
_TABLE = _rng.integers(0, 1 << 64, (_DEPTH, 256), dtype=np.uint64)
_LOWER_TABLE = np.ascontiguousarray(_TABLE[:, _LOWER]).ravel()
_FURTHER = np.uint64(int(_rng.integers(0, 1 << 63)) * 2 + 1)
_ROLES = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the len(texts) + 1 offsets into them; null is empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts, and where each text's words begin in those lists (len + 1)."""
    inside = np.zeros(len(data) + 1, bool)
    np.logical_not(apart[data], out=inside[:-1])
    edge = np.zeros(len(data) + 1, bool)  # a text's first byte starts a word even if the text before ends in one
    edge[offsets] = True
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (edge | ~before))
    ends = np.flatnonzero(before & (edge | ~inside))
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, A-Z lower-cased: the sum of a random number for every (place, byte)."""
    out = np.zeros(len(starts), np.uint64)
    lengths = ends - starts
    total = np.cumsum(lengths)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + CHUNK, "right")))
        n = lengths[a:b]
        first = np.cumsum(n) - n
        place = np.arange(int(n.sum())) - np.repeat(first, n)
        got = data[place + np.repeat(starts[a:b], n)]
        h = _LOWER_TABLE[(place % _DEPTH) * 256 + got]
        if n.max() > _DEPTH:
            powers = np.full(int(n.max()) // _DEPTH + 1, _FURTHER)
            powers[0] = 1  # so that a word's hash doesn't depend on its neighbours
            powers = np.cumprod(powers)
            h *= powers[place // _DEPTH]
        out[a:b] = np.add.reduceat(h, first) + n.astype(np.uint64) * _FURTHER
        a = b
    return mix(out)


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; of the whole sequence where it is shorter; none of none."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.uint64)
    if n < size:
        return mix((hashes * _ROLES[32 + np.arange(n) % 32]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n))
    sums = hashes[: n - size + 1] * _ROLES[0]
    for k in range(1, size):
        sums += hashes[k : n - size + 1 + k] * _ROLES[k]
    return np.unique(mix(sums))


def shingle_sets(texts: pa.Array, size: int):
    """The shingle set of every text, in order."""
    data, offsets = buffers(texts)
    starts, ends, first = words(data, offsets)
    h = word_hashes(data, starts, ends)
    for a, b in zip(first[:-1], first[1:], strict=True):
        yield shingles(h[a:b], size)
