"""Token ids of many texts with a public word BPE, one tokenizer call per distinct word.

The vocabulary's rule is: NFC, blanks joined, lower case, split into contractions,
letter runs, single digits and other runs; then BPE inside each piece. Texts of ASCII
and Latin-1 letters are split on their bytes in NumPy; pieces are looked up in a
per-worker memory of known pieces and new ones go to the tokenizer's own model. Any
other text, also one with the string of an added token, goes through the tokenizer whole. Both ways give the tokenizer's ids.
"""

from __future__ import annotations

import os
from array import array

import numpy as np
import pyarrow as pa

from marts.llm.arrays import ranges, span_hashes, text_slices

#: Pieces a worker remembers: twice so many, of which the half not used last is forgotten first
#: (results do not change).
KNOWN_PIECES = 100_000

#: Bytes of text that are split at once.
TEXT_BYTES = 1 << 20

_SPACE, _LETTER, _DIGIT, _OTHER, _FOREIGN = range(5)


def _classes() -> np.ndarray:
    out = np.full(256, _OTHER, dtype=np.uint8)
    out[:32] = _FOREIGN
    out[[9, 10, 13, 32]] = _SPACE
    out[48:58] = _DIGIT
    out[65:91] = out[97:123] = out[128:] = _LETTER
    out[127] = _FOREIGN
    return out


_CLASS = _classes()


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, others follow U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordTokenizer:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        added = self._tokenizer.get_added_tokens_decoder().values()
        self._added = [t.content.lower().encode() for t in added]
        self._model = self._tokenizer.model
        self._alphabet = str.maketrans(_byte_letters())
        self._known: dict[int, bytes] = {}
        self._older: dict[int, bytes] = {}

    def _piece(self, piece: bytes) -> bytes:
        text = piece.decode("latin-1")
        if not text.isascii():
            text = text.translate(self._alphabet)
        return array("H", [t.id for t in self._model.tokenize(text)]).tobytes()

    def encode(self, column: pa.Array) -> list[np.ndarray]:
        """The ids of each text."""
        out: list[np.ndarray] = []
        for first, data, offsets in text_slices(column, TEXT_BYTES):
            out += self._slice(column, first, data, offsets)
        return out

    def _slice(self, column, first: int, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        n = len(data)
        if n == 0:
            return [np.zeros(0, np.uint16)] * (len(offsets) - 1)
        kind = _CLASS[data]
        data = data.copy()
        data[(data >= 65) & (data <= 90)] += 32
        # Beyond ASCII only U+00C0..U+00FF without the two signs is split here.
        lead = data == 0xC3
        tail = np.zeros(n, dtype=bool)
        tail[1:] = lead[:-1]
        high = data >= 0x80
        kind[high & ~lead & ~tail] = _FOREIGN
        kind[tail & ((data == 0x97) | (data == 0xB7))] = _FOREIGN
        data[tail & (data <= 0x9E)] += 0x20
        foreign = np.add.reduceat(np.append(kind == _FOREIGN, False), offsets[:-1]) > 0
        # Added tokens are found before the split: their texts go through whole, too.
        raw = data.tobytes()
        for token in self._added:
            at = raw.find(token)
            while at >= 0:
                foreign[np.searchsorted(offsets, at, side="right") - 1] = True
                at = raw.find(token, at + 1)
        foreign[np.diff(offsets) == 0] = False
        starts, ends, bounds = _pieces(data, kind, offsets)
        ids, lengths = self._ids(data, starts, ends)
        at = np.concatenate(([0], np.cumsum(lengths)))[bounds]
        out = [ids[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        for i in np.flatnonzero(foreign):
            text = column[first + int(i)].as_py()
            out[i] = np.array(
                self._tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint16
            )
        return out

    def _ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in one array, and the number of ids of each piece."""
        if not len(starts):
            return np.zeros(0, np.uint16), np.zeros(0, np.int64)
        hashes, where, inverse = np.unique(
            span_hashes(data, starts, ends), return_index=True, return_inverse=True
        )
        if len(self._known) > KNOWN_PIECES:
            self._known, self._older = {}, self._known
        known, older, found, raw = self._known, self._older, [], data.tobytes()
        starts, ends = starts[where].tolist(), ends[where].tolist()
        for h, a, b in zip(hashes.tolist(), starts, ends, strict=True):
            ids = known.get(h)
            if ids is None:
                ids = known[h] = older.get(h) or self._piece(raw[a:b])
            found.append(ids)
        size = np.fromiter(map(len, found), np.int64, len(found)) // 2
        flat = np.frombuffer(b"".join(found), dtype=np.uint16)
        lengths = size[inverse]
        return flat[ranges((np.cumsum(size) - size)[inverse], lengths)], lengths


def _pieces(data: np.ndarray, kind: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(data)
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    start = np.empty(n, dtype=bool)
    start[0] = True
    start[1:] = kind[1:] != kind[:-1]
    start |= (kind == _DIGIT) | cut[:n]
    # A contraction starts at an apostrophe that is the first of its run.
    for i in np.flatnonzero((data == 39) & start[:n]):
        if i + 1 < n and not cut[i + 1] and kind[i + 1] == _LETTER:
            two, three = bytes(data[i + 1 : i + 2]), bytes(data[i + 1 : i + 3])
            size = 1 if two in b"stmd" else 2 if three in (b"re", b"ve", b"ll") else 0
            if size and not (size == 2 and cut[i + 2]):
                start[i + 1] = False
                j = i + 1 + size
                if j < n and kind[j] == _LETTER:
                    start[j] = True
    inside = kind != _SPACE
    end = np.empty(n, dtype=bool)
    end[-1] = True
    end[:-1] = start[1:]
    # Blanks start pieces of their own above; they are left out here.
    starts = np.flatnonzero(start & inside)
    ends = np.flatnonzero(end & inside) + 1
    return starts, ends, np.searchsorted(starts, offsets)
