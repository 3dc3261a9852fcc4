"""Sets of word shingles as 64-bit hashes, for whole batches of texts at once.

Words are what ASCII white space leaves, with A-Z lower-cased.  A word's hash
adds up random numbers for its bytes at their places (tabulation hashing), so
one pass over a batch's bytes gives all words.  A text with fewer words than a
shingle is one shingle; a text without words has none.  Null counts as empty.
Two different shingles of one comparison share a hash with a chance of about
one in 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of texts that are hashed at once; a longer text is a slice of its own.
SLICE = 1 << 20
_PLACES = 64
_random = np.random.default_rng(20)
_TABLE = _random.integers(0, 1 << 64, (_PLACES, 256), np.uint64)
_ORDER = _random.integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the finalizer of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of texts that lie one after another, and the number of words before each text's end."""
    n = len(data)
    space, cut = _SPACE[data], np.zeros(n + 1, bool)
    cut[ends] = True
    first = ~space
    first[1:] &= space[:-1] | cut[1:-1]
    last = ~space
    last[:-1] &= space[1:] | cut[1:-1]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last)
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(ends), np.int64)
    place = np.arange(n) - starts[np.maximum(np.cumsum(first) - 1, 0)]
    value = _TABLE[place % _PLACES, _LOWER[data]] * (2 * (place // _PLACES) + 1).astype(np.uint64)
    value[space] = 0
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value)])
    return mixed(sums[stops + 1] - sums[starts]), np.searchsorted(starts, ends)


def _sets(data: np.ndarray, ends: np.ndarray, size: int) -> Iterator[np.ndarray]:
    hashes, counts = words(data, ends)
    every = np.zeros(max(len(hashes) - size + 1, 0), np.uint64)
    for i in range(size):
        every += hashes[i : i + len(every)] * _ORDER[i]
    every, before = mixed(every), 0
    for end in counts.tolist():
        if end - before >= size:
            yield np.unique(every[before : end - size + 1])
        elif end > before:
            few = hashes[before:end] * _ORDER[: end - before]
            yield mixed(few.sum(keepdims=True) + np.uint64(end - before))
        else:
            yield np.empty(0, np.uint64)
        before = end


def sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a column."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, at, data = column.buffers()
    ends = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    k = 0
    while k < len(column):
        stop = max(k + 1, int(np.searchsorted(ends, ends[k] + SLICE, "right")) - 1)
        yield from _sets(data[ends[k] : ends[stop]], ends[k + 1 : stop + 1] - ends[k], size)
        k = stop
