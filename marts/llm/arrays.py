"""Words, shingles and polynomial hashes of many texts at once, on UTF-8 bytes.

Texts stay Arrow buffers; every step is one NumPy pass over the bytes of a slice
of rows, so a task needs memory in proportion to ``SLICE_BYTES`` (or to the one
text that is larger).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once.
SLICE_BYTES = 2 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)
_SHIFTS = (np.uint64(30), np.uint64(27), np.uint64(31))

#: The blanks of the word rule ``[^\x20\x09-\x0D]+``.
BLANK = np.zeros(256, dtype=bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True

#: Bytes with A-Z in lower case.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (a finaliser; one to one)."""
    h = (h ^ (h >> _SHIFTS[0])) * _MIX1
    h = (h ^ (h >> _SHIFTS[1])) * _MIX2
    return h ^ (h >> _SHIFTS[2])


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    out = []
    for base in (_BASE, inverse):
        p = np.full(n, base, dtype=np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, ``n`` of each at least."""
    return _powers(1 << max(16, int(n).bit_length()))


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Rows of a string column as ``(first row, bytes, offsets)``; null is empty.

    A slice ends before its text passes ``limit``; a longer text is alone.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    body = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(at, at[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, body[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``values[start:end]``; equal spans have equal hashes."""
    up, down = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix(h ^ ((ends - starts).astype(np.uint64) << np.uint64(40)))


def words(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of ``inside`` bytes within each text: starts, ends, and the first run of each text."""
    n = len(inside)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:n]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def shingles(
    values: np.ndarray, inside: np.ndarray, offsets: np.ndarray, size: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the ``size``-word shingles of each text, in text order, not yet distinct.

    A text with fewer words has one shingle, its whole sequence of words; one
    without words has none. Returns the hashes, their bounds per text, and the
    number of words per text.
    """
    starts, ends, first = words(inside, offsets)
    word = span_hashes(values, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    count = np.diff(first)
    several = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    bounds = np.zeros(len(count) + 1, dtype=np.int64)
    np.cumsum(several, out=bounds[1:])
    out = np.empty(bounds[-1], dtype=np.uint64)
    up, _ = powers(size + 1)
    if len(word) >= size:
        rolled = np.zeros(len(word) - size + 1, dtype=np.uint64)
        for j in range(size):
            rolled += word[j : len(word) - size + 1 + j] * up[j + 1]
        rolled = mix(rolled ^ np.uint64(size))
        long = np.flatnonzero(count >= size)
        if len(long):
            target = _ranges(bounds[long], several[long])
            out[target] = rolled[_ranges(first[long], several[long])]
    for i in np.flatnonzero((count > 0) & (count < size)):
        k = int(count[i])
        h = np.sum(word[first[i] : first[i] + k] * up[1 : k + 1], dtype=np.uint64)
        out[bounds[i]] = mix(np.array([h ^ np.uint64(k)], dtype=np.uint64))[0]
    return out, bounds, count


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All integers of the ranges ``[start, start + length)``, one after the other."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - first, lengths)


ranges = _ranges
