"""Removal of repeated substrings with distributed two-stage suffix arrays.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts anywhere else
in the table.

1. Every string of ``LENGTH`` bytes has an anchor: the least hash among the
   ``GRAM``-byte grams in it, the leftmost among equals. Equal strings have equal
   anchors. Neighbouring starts with the same anchor form a segment, about one in 85
   bytes; segments travel as (anchor, 128-bit digest, place), without text.
2. Segments are sorted by anchor and digest and read as a stream, so that no group,
   however large, is held. Segments with an equal one elsewhere are repeated whole.
   Of equal segments in one slice of texts only the first, marked, is shuffled: a
   segment that a third of all rows consist of costs one row a slice in its task.
   An anchor with one segment has no repeat. What is left are anchors with several
   different segments: one of each content is kept for the next step.
3. The texts of those segments are fetched and dealt into buckets by anchor. Each
   bucket's suffix array (two-stage sorting) and adjacent common prefixes show which
   starts repeat. An anchor with more than ``MOST_VARIANTS`` different segments (a
   passage in very many documents, with different surroundings) would make a bucket
   of its own too large: its strings are instead compared one by one, by 128-bit
   digests spread over all tasks and step 2's stream.
4. Each document's spans are joined to it, merged and cut.

Defined cases: null text is empty; rows equal in ``doc_id`` and text repeat each
other; ``doc_id`` may be null or repeated; texts shorter than ``LENGTH`` lose nothing;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marts.llm.arrays import mix, powers, text_slices
from marts.llm.suffix_array import repeated_starts
from marts.llm.workers import ship
from marts.session import new_folder

LENGTH = 200
GRAM = 32
MOST_VARIANTS = 4000
BUCKET_BYTES = 1 << 20

#: Longer texts are cut into overlapping parts, so that a position fits beside a hash.
_PART_BYTES = 4 << 20
_PLACE = np.uint64((1 << 24) - 1)

_ROW = ["doc_id", "uid"]
_SEGMENTS = (
    "anchor long, c1 long, c2 long, doc_id long, uid long, start long, count long, "
    "copied boolean, settled boolean"
)
_FOUND = "whole boolean, anchor long, doc_id long, uid long, start long, count long, several boolean"
_SPANS = "doc_id long, uid long, low long, high long"


def _least(key: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` neighbours."""
    n = len(key)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = key
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def segments(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(text, start in it, number of starts, anchor hash) of the segments of a slice of texts."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, np.zeros(0, np.uint64)
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    h = mix((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
    key = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    place = (_least(key, length - gram + 1) & _PLACE).astype(np.int64)
    sizes = np.diff(offsets)
    text = np.repeat(np.arange(len(sizes)), sizes)[: len(place)]
    valid = np.arange(len(place)) <= offsets[1:][text] - length
    new = np.ones(len(place), dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1]) | ~valid[:-1]
    first = np.flatnonzero(new & valid)
    # A segment ends before the next start or before the first start that is not valid.
    border = np.append(np.flatnonzero(new | ~valid), len(place))
    count = border[np.searchsorted(border, first, side="right")] - first
    return text[first], first - offsets[text[first]], count, h[place[first]]


def _parts(column: pa.Array, length: int):
    """Slices of texts with the offset of their first byte; long texts in overlapping parts."""
    for first, data, offsets in text_slices(column):
        if len(offsets) == 2 and len(data) > _PART_BYTES:
            for low in range(0, len(data) - length + 1, _PART_BYTES):
                part = data[low : low + _PART_BYTES + length - 1]
                yield first, low, part, np.array([0, len(part)])
        else:
            yield first, 0, data, offsets


def _digest(raw: bytes) -> bytes:
    return xxhash.xxh3_128_digest(raw)


def _two(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    pair = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
    return pair[:, 0], pair[:, 1]


def _copies(anchor: np.ndarray, c1: np.ndarray, c2: np.ndarray) -> dict[str, np.ndarray]:
    """Of equal rows at hand, the first is ``copied``; the others are ``settled``."""
    order = np.lexsort((c2, c1, anchor))
    a, x, y = anchor[order], c1[order], c2[order]
    again = np.zeros(len(order), dtype=bool)
    again[1:] = (a[1:] == a[:-1]) & (x[1:] == x[:-1]) & (y[1:] == y[:-1])
    copied, settled = np.zeros(len(order), dtype=bool), np.zeros(len(order), dtype=bool)
    settled[order] = again
    copied[order[:-1]] = again[1:] & ~again[:-1]
    return {"copied": copied, "settled": settled}


def _segment_rows(length: int, gram: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch["doc_id"]
            uid = np.asarray(batch["uid"])
            for first, low, data, offsets in _parts(batch["text"], length):
                text, start, count, anchor = segments(data, offsets, length, gram)
                if not len(text):
                    continue
                raw = data.tobytes()
                at = (offsets[text] + start).tolist()
                ends = (offsets[text] + start + count + length - 1).tolist()
                c1, c2 = _two([_digest(raw[a:b]) for a, b in zip(at, ends, strict=True)])
                row = first + text
                anchor = anchor.view(np.int64)
                yield pa.record_batch(
                    {
                        "anchor": anchor,
                        "c1": c1,
                        "c2": c2,
                        "doc_id": doc.take(pa.array(row)),
                        "uid": uid[row],
                        "start": start + low,
                        "count": count,
                    }
                    | _copies(anchor, c1, c2)
                )

    return task


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From segments in the order of (anchor, digest): repeated ones, and anchors' variants.

    Keeps one row back for the look ahead, and the first content of the anchor at hand
    until a second one shows up.
    """
    held: pa.Table | None = None
    before: tuple | None = None  # anchor, c1, c2 of the row before
    waiting: dict | None = None  # first content of the anchor at hand, not given out

    def handle(rows: pa.Table, ahead: tuple | None) -> Iterator[pa.RecordBatch]:
        nonlocal before, waiting
        a, c1, c2 = (rows[c].to_numpy() for c in ("anchor", "c1", "c2"))
        prev = [np.concatenate(([before[i] if before else 0], x[:-1])) for i, x in enumerate((a, c1, c2))]
        following = [np.append(x[1:], ahead[i] if ahead else 0) for i, x in enumerate((a, c1, c2))]
        new_anchor = a != prev[0]
        new_content = new_anchor | (c1 != prev[1]) | (c2 != prev[2])
        if before is None:
            new_anchor[0] = new_content[0] = True
        more = (a == following[0]) & (c1 == following[1]) & (c2 == following[2])
        if ahead is None:
            more[-1] = False
        more |= rows["copied"].to_numpy()
        whole = ~new_content | more
        # Contents after an anchor's first one, and the first one that they call for.
        later = np.flatnonzero(new_content & ~new_anchor)
        opened = np.maximum.accumulate(np.where(new_anchor, np.arange(len(a)), -1))
        called = opened[later]
        if waiting is not None and (called == -1).any():
            yield pa.RecordBatch.from_pylist([waiting], schema=_FOUND_ARROW)
            waiting = None
        variants = np.unique(np.concatenate((later, called[called >= 0])))
        for which, flag in ((np.flatnonzero(whole), True), (variants, False)):
            if len(which):
                part = rows.take(pa.array(which))
                yield pa.record_batch(
                    [
                        pa.array(np.full(len(which), flag)),
                        *(part[c].combine_chunks() for c in ("anchor", "doc_id", "uid", "start", "count")),
                        pa.array(more[which]),
                    ],
                    schema=_FOUND_ARROW,
                )
        if new_anchor.any():
            last = int(np.flatnonzero(new_anchor)[-1])
            if last in variants:
                waiting = None
            else:
                row = rows.slice(last, 1).to_pylist()[0]
                waiting = {k: row[k] for k in ("anchor", "doc_id", "uid", "start", "count")}
                waiting |= {"whole": False, "several": bool(more[last])}
        before = (a[-1], c1[-1], c2[-1])

    for batch in batches:
        if batch.num_rows == 0:
            continue
        rows = pa.Table.from_batches([batch])
        if held is not None:
            rows = pa.concat_tables([held, rows]).combine_chunks()
        held = rows.slice(rows.num_rows - 1)
        if rows.num_rows > 1:
            ahead = tuple(held[c][0].as_py() for c in ("anchor", "c1", "c2"))
            yield from handle(rows.slice(0, rows.num_rows - 1), ahead)
    if held is not None:
        yield from handle(held, None)


_FOUND_ARROW = pa.schema(
    [
        ("whole", pa.bool_()),
        ("anchor", pa.int64()),
        ("doc_id", pa.int64()),
        ("uid", pa.int64()),
        ("start", pa.int64()),
        ("count", pa.int64()),
        ("several", pa.bool_()),
    ]
)


def _written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    folder = new_folder(spark, name)
    df.write.parquet(folder)
    return spark.read.parquet(folder)


def _streamed(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Step 2 over segments: one shuffle by anchor, sorted, read as a stream.

    The segments are written first: which of equal ones is settled in its slice is
    then decided once, also if a lost task sees its rows in other slices.
    """
    rows = _written(spark, rows, "segments")
    order = ("anchor", "c1", "c2")
    found = (
        rows.where("not settled")
        .drop("settled")
        .repartition("anchor")
        .sortWithinPartitions(*order)
        .mapInArrow(_repeats, _FOUND)
    )
    settled = rows.where("settled").select(
        F.lit(True).alias("whole"), "anchor", *_ROW, "start", "count", F.lit(True).alias("several")
    )
    return _written(spark, found, "repeats").unionByName(settled)


def repeated_spans(
    spark: SparkSession,
    rows: DataFrame,
    *,
    length: int = LENGTH,
    gram: int = GRAM,
    most_variants: int = MOST_VARIANTS,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """``(doc_id, uid, low, high)`` byte spans, overlapping, of ``rows(doc_id, uid, text)``."""
    found = _streamed(spark, rows.mapInArrow(_segment_rows(length, gram), _SEGMENTS))
    spans = found.where("whole").select(
        *_ROW, F.col("start").alias("low"), (F.col("start") + F.col("count") + length - 1).alias("high")
    )

    # Texts of the variants: fetched once, by document.
    wanted = (
        found.where("not whole")
        .groupBy(*_ROW)
        .agg(F.collect_list(F.struct("anchor", "start", "count", "several")).alias("segments"))
    )
    key = [F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("k1"), F.col("uid").alias("k2")]
    pieces = (
        rows.select(*key, "doc_id", "uid", F.encode("text", "UTF-8").alias("raw"))
        .join(wanted.select(*key, "segments"), ["k1", "k2"])
        .select("doc_id", "uid", "raw", F.explode("segments").alias("s"))
        .select(
            *_ROW,
            "s.anchor",
            "s.start",
            "s.several",
            F.substring(F.col("raw"), (F.col("s.start") + 1).cast("int"), (F.col("s.count") + length - 1).cast("int")).alias("piece"),
        )
    )
    pieces = _written(spark, pieces, "variants")

    crowded = pieces.groupBy("anchor").count().where(F.col("count") > most_variants).select("anchor")
    few = pieces.join(crowded, "anchor", "left_anti")
    many = pieces.join(crowded, "anchor", "left_semi")
    size = few.agg(F.coalesce(F.sum(F.length("piece")), F.lit(0))).first()[0]
    buckets = max(1, -(-int(size) // bucket_bytes))
    bucketed = few.withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets)))
    by_array = bucketed.groupBy("bucket").applyInArrow(_bucket_spans(length), _SPANS)

    one_by_one = _streamed(spark, many.mapInArrow(_string_rows(length), _SEGMENTS)).where("whole")
    by_string = one_by_one.select(
        *_ROW, F.col("start").alias("low"), (F.col("start") + length).alias("high")
    )
    return spans.unionByName(by_array).unionByName(by_string)


def _bucket_spans(length: int):
    def task(group: pa.Table) -> pa.Table:
        found = repeated_starts(group["piece"].to_pylist(), length)
        several = group["several"].to_numpy(zero_copy_only=False)
        rows, low, high = [], [], []
        start = group["start"].to_pylist()
        for i, at in enumerate(found):
            if several[i] or not len(at):
                continue  # repeated whole: given out by step 2
            cuts = np.flatnonzero(np.diff(at) > 1) + 1
            for run in np.split(at, cuts):
                rows.append(i)
                low.append(start[i] + int(run[0]))
                high.append(start[i] + int(run[-1]) + length)
        take = pa.array(rows, pa.int64())
        return pa.table(
            {
                "doc_id": group["doc_id"].take(take),
                "uid": group["uid"].take(take),
                "low": pa.array(low, pa.int64()),
                "high": pa.array(high, pa.int64()),
            }
        )

    return task


def _string_rows(length: int):
    """Each string of the segments as a segment of its own, its digest being its anchor."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 256):
                batch = whole.slice(low, 256)
                digests, row, start = [], [], []
                for i, (piece, at) in enumerate(
                    zip(batch["piece"].to_pylist(), batch["start"].to_pylist(), strict=True)
                ):
                    n = len(piece) - length + 1
                    digests += [_digest(piece[j : j + length]) for j in range(n)]
                    row += [i] * n
                    start += range(at, at + n)
                c1, c2 = _two(digests)
                take = pa.array(row, pa.int64())
                yield pa.record_batch(
                    {
                        "anchor": c1,
                        "c1": c1,
                        "c2": c2,
                        "doc_id": batch["doc_id"].take(take),
                        "uid": batch["uid"].take(take),
                        "start": pa.array(start, pa.int64()),
                        "count": pa.array(np.ones(len(row), np.int64)),
                    }
                    | _copies(c1, c1, c2)
                )

    return task


def merged(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of spans given as ``low << 32 | high``, touching ones joined."""
    packed = np.sort(packed)
    low, high = packed >> 32, np.maximum.accumulate(packed & 0xFFFFFFFF)
    new = np.concatenate(([True], low[1:] > high[:-1]))
    last = np.append(np.flatnonzero(new)[1:] - 1, len(packed) - 1)
    return low[new], high[last]


def remove_repeats(
    spark: SparkSession, docs: DataFrame, *, key: str = "doc_id", text: str = "text", **options
) -> DataFrame:
    """``(doc_id, kept, n_bytes, n_removed, spans)``, one row per row of ``docs``.

    ``kept`` are the remaining bytes (a span may end inside a character), ``spans``
    the removed runs as byte offsets of the input.
    """
    ship(spark)
    value = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        F.xxhash64(F.col(key), value).alias("uid"),
        value.alias("text"),
    )
    spans = (
        repeated_spans(spark, rows, **options)
        .groupBy(
            F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("k1"), F.col("uid").alias("k2")
        )
        .agg(F.collect_list(F.shiftleft("low", 32).bitwiseOR(F.col("high"))).alias("packed"))
    )
    joined = rows.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("k1"),
        F.col("uid").alias("k2"),
        "doc_id",
        "text",
    ).join(spans, ["k1", "k2"], "left")
    return joined.select("doc_id", "text", "packed").mapInArrow(
        _cut,
        "doc_id long, kept binary, n_bytes long, n_removed long, "
        "spans array<struct<low:bigint,high:bigint>>",
    )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, sizes, removed, spans = [], [], [], []
        for text, packed in zip(batch["text"].to_pylist(), batch["packed"], strict=True):
            raw = text.encode()
            sizes.append(len(raw))
            if not packed.is_valid:
                kept.append(raw)
                removed.append(0)
                spans.append([])
                continue
            low, high = merged(np.asarray(packed.values, dtype=np.int64))
            parts, at = [], 0
            for a, b in zip(low.tolist(), high.tolist(), strict=True):
                parts.append(raw[at:a])
                at = b
            kept.append(b"".join([*parts, raw[at:]]))
            removed.append(int((high - low).sum()))
            spans.append([{"low": a, "high": b} for a, b in zip(low.tolist(), high.tolist(), strict=True)])
        yield pa.record_batch(
            {
                "doc_id": batch["doc_id"],
                "kept": pa.array(kept, pa.binary()),
                "n_bytes": pa.array(sizes, pa.int64()),
                "n_removed": pa.array(removed, pa.int64()),
                "spans": pa.array(
                    spans, pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))
                ),
            }
        )
