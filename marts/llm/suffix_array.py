"""Suffix arrays by two-stage sorting, in NumPy, for texts of a few megabytes.

Suffixes smaller than their successor are sorted directly. All others follow from
them by one scan over the first bytes' buckets: when a bucket is complete, the
suffixes that start one byte earlier with a greater byte go, in the same order, to
the ends of their own buckets' induced parts.
"""

from __future__ import annotations

import numpy as np

_WORD = 8


def join_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One text in which 0 ends each given one, and where each starts.

    UTF-8 has no byte above 0xF4, so adding one to each byte leaves 0 free.
    """
    data = np.frombuffer(b"\xff".join([*texts, b""]), dtype=np.uint8) + np.uint8(1)
    starts = np.zeros(len(texts), dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts[:-1]], out=starts[1:])
    return data, starts


class _Words:
    """Eight bytes from any position as one number; beyond the end there are zeros."""

    def __init__(self, text: np.ndarray, depth: int) -> None:
        padded = np.concatenate((text, np.zeros(depth + 2 * _WORD, dtype=np.uint8)))
        self._view = np.ndarray(len(text) + depth + _WORD, dtype=">u8", buffer=padded, strides=(1,))

    def at(self, index: np.ndarray) -> np.ndarray:
        return self._view[index].astype(np.uint64)


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than the suffix one byte later; the last counts as such."""
    n = len(text)
    step = np.sign(np.diff(text.astype(np.int16)))
    # Equal bytes take the answer of the next position that differs.
    known = np.where(step != 0, np.arange(n - 1), n - 1)
    known = np.minimum.accumulate(known[::-1])[::-1]
    return np.append(step, 1)[np.append(known, n - 1)] > 0


def sort_directly(words: _Words, index: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` bytes, a word of eight at a time."""
    key = words.at(index)
    order = np.argsort(key, kind="stable")
    index, key = index[order], key[order]
    group = np.concatenate(([0], np.cumsum(key[1:] != key[:-1]))) if len(key) else key
    for at in range(_WORD, depth, _WORD):
        size = np.bincount(group.astype(np.int64)) if len(group) else np.zeros(0, np.int64)
        tied = np.flatnonzero(size[group] > 1) if len(group) else group
        if not len(tied):
            break
        own = group[tied]
        key = words.at(index[tied] + at)
        differs = (key[1:] != key[:-1]) & (own[1:] == own[:-1])
        if not differs.any():
            continue
        open_groups = np.zeros(int(own[-1]) + 1, dtype=bool)
        open_groups[own[1:][differs]] = True
        some = np.flatnonzero(open_groups[own])
        order = np.lexsort((key[some], own[some]))
        index[tied[some]] = index[tied[some[order]]]
        key[some] = key[some[order]]
        border = np.zeros(len(index), dtype=bool)
        border[0] = False
        border[1:] = group[1:] != group[:-1]
        border[tied[1:][(key[1:] != key[:-1]) & (own[1:] == own[:-1])]] = True
        group = np.cumsum(border)
    return index


def suffix_array(text: np.ndarray, depth: int, words: _Words | None = None) -> np.ndarray:
    """All suffixes in the order of (at least) their first ``depth`` bytes."""
    words = words or _Words(text, depth)
    direct = smaller_than_next(text)
    first = sort_directly(words, np.flatnonzero(direct), depth)
    bounds = np.searchsorted(text[first], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in range(256):
        bucket = induced[c]
        at = 0
        while at < len(bucket):  # runs of the bucket's own byte follow one another
            before = bucket[at][bucket[at] > 0] - 1
            same = before[(text[before] == c) & ~direct[before]]
            if len(same):
                bucket.append(same)
            at += 1
        whole = np.concatenate([*bucket, first[bounds[c] : bounds[c + 1]]])
        if not len(whole):
            continue
        out.append(whole)
        before = whole[whole > 0] - 1
        before = before[~direct[before] & (text[before] > c)]
        if len(before):
            byte = text[before]
            order = np.argsort(byte, kind="stable")
            before, byte = before[order], byte[order]
            cuts = np.flatnonzero(byte[1:] != byte[:-1]) + 1
            for part in np.split(before, cuts):
                induced[text[part[0]]].append(part)
        induced[c] = []
    return np.concatenate(out)


def common_prefixes(words: _Words, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """Lengths of the common prefixes of suffix pairs, up to ``limit`` (a multiple of eight)."""
    out = np.zeros(len(a), dtype=np.int64)
    left = np.arange(len(a))
    for at in range(0, limit, _WORD):
        x = words.at(a[left] + at) ^ words.at(b[left] + at)
        equal = x == 0
        if not equal.all():
            rest = x[~equal]
            zeros = np.zeros(len(rest), dtype=np.int64)
            for byte in range(1, _WORD):
                zeros += rest < np.uint64(1 << (8 * byte))
            out[left[~equal]] = at + zeros
            left = left[equal]
            if not len(left):
                break
    out[left] = limit
    return out


def repeated_starts(texts: list[bytes], length: int) -> list[np.ndarray]:
    """Per text, the positions at which a string starts that also starts anywhere else.

    ``length`` must be a multiple of eight.
    """
    if not texts:
        return []
    text, starts = join_texts(texts)
    words = _Words(text, length)
    order = suffix_array(text, length, words)
    ends = np.append(starts[1:], len(text)) - 1
    owner = np.searchsorted(starts, order, side="right") - 1
    order = order[ends[owner] - order >= length]
    repeated = np.zeros(len(text), dtype=bool)
    if len(order) > 1:
        same = common_prefixes(words, order[:-1], order[1:], length) >= length
        repeated[order[:-1][same]] = True
        repeated[order[1:][same]] = True
    return [np.flatnonzero(repeated[a:b]) for a, b in zip(starts, ends, strict=True)]
