"""Packing along a space-filling curve.

Each document's set of token ids is projected by fixed random signs to ``DIMENSIONS``
numbers; their quantised point has a place on a Hilbert curve. In the order of the
curve (a hash of the document among equals) all documents' ids form one line, which
is cut every ``LENGTH`` ids: neighbours on the curve share sequences, and nothing is
padded. What is left at the end becomes sequences whose lengths are powers of two.

Scale: ids are computed once and written to the shared folder; the order comes from
sums over cells of the sort key, so that no task sees more than one cell's rows and
copies of one document, equal on the curve, spread over 256 cells by their id's
hash. Ids are shuffled once. The driver gets one number, the total.

Defined cases: null text is empty and is a document of the end id alone; documents
with equal ids and texts are told apart by nothing, so each simply takes its own place
on the line; a null ``doc_id`` is kept; an empty table gives no sequence.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marts.llm.tokens import WordTokenizer
from marts.llm.workers import lean, ship, small_batches
from marts.session import new_folder

LENGTH = 2048
END_ID = 1
DIMENSIONS = 4
BITS = 4
_SEED = 20240601
#: Rows that a task works on at once.
_ROWS = 1024
_CELL_BITS = 24  # of the sort key: 16 of the curve, 8 of the document's hash

TOKENIZED = "doc_id long, key long, tie string, n long, ids binary"
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, ids binary"
)


@lru_cache(maxsize=1)
def _tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


@lru_cache(maxsize=1)
def _signs() -> np.ndarray:
    return np.random.default_rng(_SEED).choice([-1.0, 1.0], size=(1 << 16, DIMENSIONS)).astype(np.float32)


def place(ids: np.ndarray) -> np.ndarray:
    """The quantised point of a set of ids; an empty set is in the middle."""
    distinct = np.unique(ids)
    if not len(distinct):
        z = np.zeros(DIMENSIONS)
    else:
        z = _signs()[distinct].sum(axis=0) / np.sqrt(len(distinct))
    share = 1 / (1 + np.exp(-1.702 * z))
    return np.minimum((share * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of points with ``bits`` bits in each column.

    The coordinates are turned in place into the curve index's bits, dealt out over
    the columns from the highest bit down.
    """
    x = points.astype(np.int64).T.copy()
    d = len(x)
    level = 1 << (bits - 1)
    while level > 1:
        mask = level - 1
        for i in range(d):
            up = (x[i] & level) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & mask)
            x[0] ^= np.where(up, mask, swap)
            x[i] ^= swap
        level >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    level = 1 << (bits - 1)
    while level > 1:
        turn ^= np.where((x[-1] & level) != 0, level - 1, 0)
        level >>= 1
    x ^= turn
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def tokenized(docs: DataFrame, vocabulary: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Ids with the end id, and the sort key: the curve's 16 bits over 47 bits of a hash of the id."""
    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        F.xxhash64(key).bitwiseAND(F.lit((1 << 47) - 1)).alias("hash"),
        F.col(text).alias("text"),
    )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _tokenizer(vocabulary)
        for whole in batches:
            for low in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(low, _ROWS)
                ids = encoder.encode(batch["text"])
                curve = hilbert(np.array([place(x) for x in ids]).reshape(len(ids), DIMENSIONS))
                closed = [np.append(x, np.uint16(END_ID)).tobytes() for x in ids]
                yield pa.record_batch(
                    {
                        "doc_id": batch["doc_id"],
                        "key": pa.array((curve << 47) | np.asarray(batch["hash"], dtype=np.int64)),
                        "tie": pa.array([f"{zlib.crc32(x):08x}" for x in closed]),
                        "n": pa.array([len(x) // 2 for x in closed], pa.int64()),
                        "ids": pa.array(closed, pa.binary()),
                    }
                )

    ship(docs.sparkSession)
    return rows.mapInArrow(lean(task), TOKENIZED)


def pack(
    spark: SparkSession,
    docs: DataFrame,
    vocabulary: str,
    *,
    key: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
) -> DataFrame:
    """Pieces of documents with their sequence and place in it; ``ids`` are 16-bit, little-endian."""
    folder = new_folder(spark, "packing")
    with small_batches(spark):
        tokenized(docs, vocabulary, key=key, text=text).write.parquet(folder)
    rows = spark.read.parquet(folder)
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    cell = F.shiftright("key", 63 - _CELL_BITS)
    cells = rows.groupBy(cell.alias("cell")).agg(F.sum("n").alias("n"))
    region = F.shiftright("cell", _CELL_BITS // 2)
    regions = cells.groupBy(region.alias("region")).agg(F.sum("n").alias("n"))
    before = lambda *part: (
        Window.partitionBy(*part).rowsBetween(Window.unboundedPreceding, -1)
    )
    none = F.lit(0).cast("long")
    # At most 2^12 regions, and 2^12 cells in each.
    regions = regions.select(
        "region", F.coalesce(F.sum("n").over(before().orderBy("region")), none).alias("region_at")
    )
    cells = (
        cells.withColumn("region", region)
        .join(regions, "region")
        .select(
            "cell",
            (
                F.col("region_at")
                + F.coalesce(F.sum("n").over(before("region").orderBy("cell")), none)
            ).alias("cell_at"),
        )
    )
    placed = (
        rows.withColumn("cell", cell)
        .withColumn(
            "inside",
            F.coalesce(F.sum("n").over(before("cell").orderBy("key", "doc_id", "tie")), none),
        )
        .join(cells, "cell")
        .select("doc_id", (F.col("cell_at") + F.col("inside")).alias("at"), "n", "ids")
    )
    return placed.mapInArrow(lean(_cutter(int(total), length)), PIECES)


def borders(total: int, length: int) -> list[tuple[int, int]]:
    """Starts and lengths of the sequences behind the last whole one: powers of two."""
    at = total - total % length
    out = []
    for bit in range(length.bit_length() - 1, -1, -1):
        if total % length >> bit & 1:
            out.append((at, 1 << bit))
            at += 1 << bit
    return out


def _cutter(total: int, length: int):
    whole = total // length
    tail = borders(total, length)

    def pieces(at: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        """(start in the document, length, sequence, offset in it)"""
        done = 0
        while done < n:
            p = at + done
            if p < whole * length:
                sequence, offset, room = p // length, p % length, length - p % length
            else:
                i = next(i for i, (a, m) in enumerate(tail) if a <= p < a + m)
                sequence, offset, room = whole + i, p - tail[i][0], sum(tail[i]) - p
            size = min(room, n - done)
            yield done, size, sequence, offset
            done += size

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(low, _ROWS) for b in batches for low in range(0, b.num_rows, _ROWS)):
            out = []
            for doc, at, n, ids in zip(*(batch[c].to_pylist() for c in ("doc_id", "at", "n", "ids")), strict=True):
                wide = np.frombuffer(ids, "<u2").astype("<u4")
                for start, size, sequence, offset in pieces(at, n):
                    crc = zlib.crc32(wide[start : start + size])
                    out.append((doc, start, size, crc, n, sequence, offset, ids[2 * start : 2 * (start + size)]))
            names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
            columns = list(zip(*out, strict=True)) if out else [()] * 8
            arrays = {c: pa.array(v, pa.int64()) for c, v in zip(names, columns, strict=False)}
            yield pa.record_batch(arrays | {"ids": pa.array(columns[7], pa.binary())})

    return task
