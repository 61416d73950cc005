"""Benchmark decontamination: size-partitioned MinHash containment search.

An item is in a document if at least ``CONTAINMENT`` of the item's distinct five-word
shingles are among the document's. Items are partitioned by their number of shingles;
each partition has its own sketch size. An item's sketch is its ``q - ceil(0.8 q) + 1``
smallest shingle hashes: a document that contains the item lacks at most the other
``q - ceil(0.8 q)``, so it shares at least one hash of the sketch. Documents with too
few shingles for a size partition are not compared to it. The search therefore loses
nothing, however long the document; what it finds is verified on the words themselves.

Words are runs of ASCII letters, digits and bytes beyond ASCII, A-Z in lower case, so
punctuation strewn into a passage does not hide it. An item of fewer than five words
has one shingle, all its words, and is looked for as a run of that many words.

Scale: the items come in blocks of at most ``BLOCK_BYTES`` of text, each sent along
with its own pass over the documents; documents never leave their task. One block
holds all of a usual benchmark.

Defined cases: null text has no words; an item without words is in no document; equal
items (id and text) count once, one with a null id is given back with a null id; repeated documents are each marked; empty tables give
no marks. Other columns pass through; a column named ``leaks`` is replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marts.llm.arrays import LOWER, shingles, text_slices
from marts.llm.workers import lean, ship

SIZE = 5
CONTAINMENT = 0.8
BLOCK_BYTES = 8 << 20

_INSIDE = np.zeros(256, dtype=bool)
_INSIDE[48:58] = _INSIDE[65:91] = _INSIDE[97:123] = _INSIDE[128:] = True
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")

LEAKS = "array<struct<item_id:bigint,item_shingles:bigint,shared:bigint>>"
_LEAKS = pa.list_(
    pa.struct([("item_id", pa.int64()), ("item_shingles", pa.int64()), ("shared", pa.int64())])
)


def word_shingles(text: str, size: int) -> set[tuple[bytes, ...]]:
    """The distinct ``size``-word shingles of a text as words."""
    words = _WORD.findall(text.encode().translate(bytes(LOWER)))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def needed(shingles: int, containment: float) -> int:
    return math.ceil(shingles * containment - 1e-9)


class Sketches:
    """The sketches of a block of items, by shingle size and size partition."""

    def __init__(self, items: list[tuple[int, str]], containment: float, size: int) -> None:
        self.containment = containment
        self.items = items
        self.exact: list[set] = []
        self.width: list[int] = []
        parts: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for i, (_, text) in enumerate(items):
            n = len(_WORD.findall(text.encode()))
            width = min(size, n)
            self.width.append(width)
            self.exact.append(word_shingles(text, width) if n else set())
            if n:
                data = np.frombuffer(text.encode(), dtype=np.uint8)
                h, _, _ = shingles(LOWER[data], _INSIDE[data], np.array([0, len(data)]), width)
                h = np.unique(h)
                keep = len(h) - needed(len(h), containment) + 1
                part = parts.setdefault((width, len(h).bit_length()), [])
                part += [(int(x), i) for x in h[:keep]]
        self.parts = []
        for (width, bits), pairs in sorted(parts.items()):
            pairs.sort()
            self.parts.append(
                (
                    width,
                    needed(1 << (bits - 1), containment),
                    np.array([h for h, _ in pairs], dtype=np.uint64),
                    np.array([i for _, i in pairs]),
                )
            )

    def candidates(self, data: np.ndarray, offsets: np.ndarray) -> set[tuple[int, int]]:
        """(text, item) pairs that share a sketch hash."""
        out: set[tuple[int, int]] = set()
        inside, lower = _INSIDE[data], LOWER[data]
        done: dict[int, tuple] = {}
        for width, least, hashes, owner in self.parts:
            if width not in done:
                h, bounds, count = shingles(lower, inside, offsets, width)
                done[width] = (h, np.repeat(np.arange(len(count)), np.diff(bounds)), count)
            h, text, count = done[width]
            long = count[text] - width + 1 >= least
            h, text = h[long], text[long]
            low = np.searchsorted(hashes, h, side="left")
            low[low == len(hashes)] = 0
            for k in np.flatnonzero(hashes[low] == h):
                j = low[k]
                while j < len(hashes) and hashes[j] == h[k]:
                    out.add((int(text[k]), int(owner[j])))
                    j += 1
        return out

    def leaks(self, column: pa.Array) -> list[list[tuple[int, int, int]]]:
        """Per text the items that it contains: id, shingles, shared shingles."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(column))]
        for first, data, offsets in text_slices(column):
            own: dict[tuple[int, int], set] = {}
            for t, i in sorted(self.candidates(data, offsets)):
                key = (t, self.width[i])
                if key not in own:
                    own[key] = word_shingles(column[first + t].as_py(), key[1])
                shared = len(self.exact[i] & own[key])
                if shared >= needed(len(self.exact[i]), self.containment):
                    out[first + t].append((self.items[i][0], len(self.exact[i]), shared))
        return [sorted(x, key=_nulls_first) for x in out]


def _nulls_first(row: tuple) -> tuple:
    return (row[0] is not None, row[0] or 0, *row[1:])


def mark_leaks(
    docs: DataFrame,
    items: DataFrame,
    *,
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    containment: float = CONTAINMENT,
    size: int = SIZE,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with ``leaks``: the benchmark items that each document contains."""
    ship(docs.sparkSession)
    items = (
        items.select(F.col(item_key).cast("long").alias("id"), F.col(item_text).alias("text"))
        .dropna(subset=["text"])
        .distinct()
    )
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(total / block_bytes))
    docs = docs.drop("leaks").withColumn("leaks", F.array().cast(LEAKS))
    for b in range(blocks):
        block = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b)
        rows = sorted(((r.id, r.text) for r in block.collect()), key=_nulls_first)
        docs = docs.mapInArrow(lean(_marker(Sketches(rows, containment, size), text)), docs.schema)
    return docs


def _marker(sketches: Sketches, text: str):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 1024):
                batch = whole.slice(low, 1024)
                names = batch.schema.names
                found = sketches.leaks(batch.column(names.index(text)))
                at = names.index("leaks")
                old = batch.column(at).to_pylist()
                both = [
                    [*(x or []), *({"item_id": i, "item_shingles": q, "shared": s} for i, q, s in f)]
                    for x, f in zip(old, found, strict=True)
                ]
                columns = list(batch.columns)
                columns[at] = pa.array(both, batch.schema.field(at).type)
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return task
