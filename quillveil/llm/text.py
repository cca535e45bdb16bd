"""Vectorised words and word shingles over the bytes of an Arrow text column.

A word is a maximal run of bytes other than space and 0x09-0x0D; letters A-Z are lower-cased first. A word's hash is a
polynomial over its bytes modulo 2**64, a shingle's hash mixes those of its words. Two different shingles share a hash
with probability about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


_BYTE = mix(np.arange(1, 257, dtype=U) * U(_BASE))
_LOWERED = np.where(SPACE, U(0), _BYTE[LOWER])
_SLOT = mix(np.arange(1, 65, dtype=U) * U(_INVERSE)) | U(1)
_powers = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 19)
        for k, b in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, b, U)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0], _powers[1]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    if column.type != pa.large_string():
        column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `most` bytes; a longer row is a range of its own."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, b
        a = b


def words(buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start byte of each word, its hash, and the first word of each row (n + 1 entries)."""
    n = len(offsets) - 1
    if not len(buffer):
        return np.zeros(0, np.int64), np.zeros(0, U), np.zeros(n + 1, np.int64)
    solid = ~SPACE[buffer]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    at = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[at] = solid[at]
    starts = np.flatnonzero(first)
    if not len(starts):
        return starts, np.zeros(0, U), np.zeros(n + 1, np.int64)
    up, down = powers(len(buffer))
    values = _LOWERED[buffer]
    values *= up[: len(buffer)]
    return starts, mix(np.add.reduceat(values, starts) * down[starts]), np.searchsorted(starts, offsets)


def shingles(buffer: np.ndarray, offsets: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each row in order, and the offsets of the rows' hashes.

    A row of fewer than k words has its whole sequence as its one shingle; a row without words has none.
    """
    _, hashes, rows = words(buffer, offsets)
    counts = np.diff(rows)
    full = np.maximum(counts - k + 1, (counts > 0).astype(np.int64))
    ends = np.concatenate(([0], np.cumsum(full)))
    out = np.empty(ends[-1], U)
    if len(hashes) >= k:
        m = len(hashes) - k + 1
        joint = hashes[:m] * _SLOT[0]
        for j in range(1, k):
            joint += hashes[j : j + m] * _SLOT[j]
        joint = mix(joint)
        long_rows = np.flatnonzero(counts >= k)
        if len(long_rows) == len(counts) and len(counts) == 1:
            out[:] = joint
        else:
            spread = np.repeat(rows[long_rows] - ends[long_rows], full[long_rows])
            target = np.repeat(ends[long_rows], full[long_rows]) + _ramp(full[long_rows])
            out[target] = joint[target + spread]
    for r in np.flatnonzero((counts > 0) & (counts < k)):
        own = hashes[rows[r] : rows[r + 1]]
        out[ends[r]] = mix(np.array([(own * _SLOT[: len(own)]).sum(dtype=U) + U(len(own))]))[0]
    return out, ends


def _ramp(counts: np.ndarray) -> np.ndarray:
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


def shingle_sets(column: pa.Array, k: int = 5) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    buffer, offsets = text_buffer(column)
    for a, b in pieces(offsets):
        hashes, ends = shingles(buffer[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k)
        for r in range(b - a):
            own = np.sort(hashes[ends[r] : ends[r + 1]])
            if len(own) > 1:
                own = own[np.concatenate(([True], own[1:] != own[:-1]))]
            yield own
