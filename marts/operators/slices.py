"""Cut a backlog into contiguous cursor ranges of bounded size."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cursor import Bounds, Cursor, CursorColumns, past, slice_bounds, to_cursor, up_to

# Ranges that one planning step makes of a range at most; a larger backlog is
# cut into ranges of ranges, each planned when it is reached.
FAN_OUT = 1024
# Cut points per slice, as expected: a gap above the limit is one in e**16.
POINTS = 16
# Times as many points where a gap was above the limit all the same.
FINER = 8


@dataclass(frozen=True)
class Slice:
    """The ``rows`` rows with ``lo < (key, id) <= hi``; a NULL bound is open."""

    lo: Cursor | None
    hi: Cursor | None
    rows: int

    def of(self, df: DataFrame, columns: CursorColumns) -> DataFrame:
        if self.lo is not None:
            df = df.where(past(columns, self.lo))
        if self.hi is not None:
            df = df.where(up_to(columns, self.hi))
        return df


def plan_slices(
    df: DataFrame, columns: CursorColumns, max_rows: int, bounds: Bounds | None = None
) -> Iterator[Slice]:
    """Slices of ``df`` in cursor order, none with more than ``max_rows`` rows.

    Cuts are ``(key, id)`` pairs, so one timestamp shared by a third of the rows
    is cut by id inside it. Only rows equal in both columns stay together, even
    above ``max_rows``: a cursor cannot stop between them.

    Cut points are pairs picked by hash; one aggregate counts the rows between
    all of them, and only ranges above the limit get further points. What is
    brought to the driver is the points, about ``POINTS * FAN_OUT`` of them
    whatever the backlog holds. Slices are planned lazily, range by range.
    """
    if max_rows < 1:
        raise ValueError("max_rows must be positive")
    bounds = bounds or slice_bounds(df, columns)
    if bounds.rows:
        yield from _cut(df, columns, max_rows, Slice(None, bounds.last, bounds.rows))


def _cut(df: DataFrame, columns: CursorColumns, max_rows: int, whole: Slice) -> Iterator[Slice]:
    if whole.rows <= max_rows:
        yield whole
        return
    limit = max_rows * -(-whole.rows // (max_rows * FAN_OUT))
    parts = list(_fill(_ranges(whole.of(df, columns), columns, limit, whole), limit))
    if limit == max_rows or len(parts) == 1:  # one part: one pair
        yield from parts
        return
    for part in parts:
        yield from _cut(df, columns, max_rows, part)


def _ranges(df: DataFrame, columns: CursorColumns, limit: int, whole: Slice) -> list[Slice]:
    """Counted ranges of ``whole``, each within ``limit`` or a single pair."""
    ends, too_large = [whole.hi], [True]
    stride = max(1, limit // POINTS)
    while True:
        points = _points(df, columns, stride, ends, too_large)
        ends = sorted({*points, *ends}, key=Cursor.order)
        counts = _counts(df, columns, ends)
        too_large = [rows > limit for rows in counts]
        if stride == 1 or not any(too_large):  # with stride 1 every pair is a point
            break
        stride = max(1, stride // FINER)
    starts = [whole.lo, *ends[:-1]]
    return [Slice(lo, hi, rows) for lo, hi, rows in zip(starts, ends, counts, strict=True) if rows]


def _range_of(schema: T.StructType, columns: CursorColumns, ends: list[Cursor]) -> Column:
    """The number of the range a row is in: how many ``ends`` lie before its pair, by
    binary search in a constant array."""

    def constants(values: list[str], name: str) -> Column:
        texts = F.from_json(F.lit(json.dumps(values)), "array<string>")
        return texts.cast(f"array<{schema[name].dataType.simpleString()}>")

    keys = constants([end.key for end in ends], columns.key)
    ids = constants([end.id for end in ends], columns.id)
    key, id_ = F.col(columns.key), F.col(columns.id)

    def step(found: Column, width: Column) -> Column:
        k, i = F.get(keys, found + width - 1), F.get(ids, found + width - 1)
        return F.when((k < key) | ((k == key) & (i < id_)), found + width).otherwise(found)

    widths = [1 << n for n in reversed(range(len(ends).bit_length()))]
    return F.aggregate(F.array(*map(F.lit, widths)), F.lit(0), step)


def _points(
    df: DataFrame, columns: CursorColumns, stride: int, ends: list[Cursor], wanted: list[bool]
) -> list[Cursor]:
    """One pair in ``stride`` of the wanted ranges.

    Picked by hash of the pair: repeatable, independent of the partitioning, and
    a pair repeated a billion times is still one point. No row is left out of a slice.
    """
    key, id_ = F.col(columns.key), F.col(columns.id)
    picked = df.where(F.pmod(F.xxhash64(key, id_), F.lit(stride)) == 0)
    flags = F.from_json(F.lit(json.dumps(wanted)), "array<boolean>")
    picked = picked.where(F.get(flags, _range_of(df.schema, columns, ends)))
    if isinstance(df.schema[columns.key].dataType, T.TimestampType):
        key = F.unix_micros(key)
    pairs = picked.select(key.alias("key"), id_.alias("id")).distinct().collect()
    return [to_cursor(pair, df.schema, columns) for pair in pairs]


def _counts(df: DataFrame, columns: CursorColumns, ends: list[Cursor]) -> list[int]:
    """Rows in each range, all in one pass."""
    place = _range_of(df.schema, columns, ends).alias("place")
    found = {r["place"]: r["rows"] for r in df.groupBy(place).agg(F.count(F.lit(1)).alias("rows")).collect()}
    return [found.get(i, 0) for i in range(len(ends))]


def _fill(ranges: list[Slice], limit: int) -> Iterator[Slice]:
    """Neighbours joined up to ``limit`` rows."""
    now = ranges[0]
    for piece in ranges[1:]:
        if now.rows + piece.rows > limit:
            yield now
            now = piece
        else:
            now = Slice(now.lo, piece.hi, now.rows + piece.rows)
    yield now
