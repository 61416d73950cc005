"""Keyset cursor over ``(timestamp, id)``: where a read resumes, where it ended."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass
from datetime import datetime, timedelta, timezone
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
_ID_TYPES = (T.IntegralType, T.StringType, T.DecimalType, T.DateType)


@dataclass(frozen=True)
class CursorColumns:
    """The two reader columns a cursor is made of; both are required."""

    key: str
    id: str

    def __post_init__(self) -> None:
        for name in (self.key, self.id):
            if not name or not _IDENTIFIER.fullmatch(name):
                raise ValueError(f"not a column name: {name!r}")


@dataclass(frozen=True)
class Cursor:
    """Last processed ``(key, id)`` with the types they had in the source.

    ``key`` is ISO text with six fraction digits, ``id`` its text form; both are
    compared in their own type, never as text.
    """

    key: str
    id: str
    key_type: str
    id_type: str

    def __post_init__(self) -> None:
        if self.key is None or self.id is None:
            raise ValueError("a cursor needs both a key and an id")

    def to_json(self) -> dict[str, str]:
        return asdict(self)

    def order(self) -> tuple[Any, Any]:
        numeric = self.id_type in ("tinyint", "smallint", "int", "bigint")
        exact = numeric or self.id_type.startswith("decimal")
        return (datetime.fromisoformat(self.key), Decimal(self.id) if exact else self.id)


def check_cursor_columns(schema: T.StructType, columns: CursorColumns) -> None:
    """Both columns present, key a timestamp, id of an ordered plain type."""
    for name in (columns.key, columns.id):
        if name not in schema.names:
            raise ValueError(f"the source query does not return cursor column {name!r}")
    key_type = schema[columns.key].dataType
    if not isinstance(key_type, (T.TimestampType, T.TimestampNTZType)):
        raise ValueError(f"cursor key {columns.key!r} must be a timestamp, is {key_type}")
    id_type = schema[columns.id].dataType
    if not isinstance(id_type, _ID_TYPES):
        raise ValueError(f"cursor id {columns.id!r} has unsupported type {id_type}")


def _literals(cursor: Cursor) -> tuple[Column, Column]:
    # Casts of literals fold at planning time, so the filters reach the scan in
    # the column's own type.
    return F.lit(cursor.key).cast(cursor.key_type), F.lit(cursor.id).cast(cursor.id_type)


def past(columns: CursorColumns, cursor: Cursor) -> Column:
    """Rows after the cursor. ``key >= ts`` stands alone so that it prunes."""
    key, id_ = F.col(columns.key), F.col(columns.id)
    ts, last = _literals(cursor)
    return (key >= ts) & ((key > ts) | (id_ > last))


def up_to(columns: CursorColumns, cursor: Cursor) -> Column:
    """Rows up to and including the cursor."""
    key, id_ = F.col(columns.key), F.col(columns.id)
    ts, last = _literals(cursor)
    return (key <= ts) & ((key < ts) | (id_ <= last))


def backlog(
    df: DataFrame,
    columns: CursorColumns,
    cursor: Cursor | None,
    overlap: timedelta | None = None,
    keep_null_rows: bool = False,
) -> DataFrame:
    """Rows still to be read.

    ``overlap`` re-reads that much time before the cursor (backdated updates;
    safe because the sinks are keyed). ``keep_null_rows`` leaves rows with a
    NULL cursor column in, for a caller that counts and rejects them.
    """
    key, id_ = F.col(columns.key), F.col(columns.id)
    present = key.isNotNull() & id_.isNotNull()
    if cursor is None:
        return df if keep_null_rows else df.where(present)
    ts, last = _literals(cursor)
    if overlap is not None:
        wanted = key > ts - F.lit(overlap)
    elif keep_null_rows:
        wanted = (key >= ts) & ((key > ts) | id_.isNull() | (id_ > last))
    else:
        wanted = past(columns, cursor)
    if keep_null_rows:
        return df.where(key.isNull() | wanted)
    return df.where(present & wanted)


def cursor_order(columns: CursorColumns) -> list[Column]:
    return [F.asc_nulls_last(columns.key), F.asc_nulls_last(columns.id)]


def first_rows(df: DataFrame, columns: CursorColumns, limit: int) -> DataFrame:
    """The first ``limit`` rows in cursor order (a top-n, not a global sort)."""
    return df.orderBy(*cursor_order(columns)).limit(limit)


def bounds_aggregates(schema: T.StructType, columns: CursorColumns) -> list[Column]:
    """Row count, NULL count, first and last ``(key, id)``: for ``agg`` or ``observe``."""
    key, id_ = F.col(columns.key), F.col(columns.id)
    missing = key.isNull() | id_.isNull()
    if isinstance(schema[columns.key].dataType, T.TimestampType):
        key = F.unix_micros(key)  # exact, and free of the driver's time zone
    pair = F.when(~missing, F.struct(key.alias("key"), id_.alias("id")))
    return [
        F.count(F.lit(1)).alias("rows"),
        F.count_if(missing).alias("null_rows"),
        F.min(pair).alias("first"),
        F.max(pair).alias("last"),
    ]


def to_cursor(pair: Row | None, schema: T.StructType, columns: CursorColumns) -> Cursor | None:
    """A ``(key, id)`` row of :func:`bounds_aggregates` as a cursor."""
    if pair is None:
        return None
    key, id_ = pair[0], pair[1]
    if isinstance(key, int):
        key = _EPOCH + timedelta(microseconds=key)
    return Cursor(
        key=key.isoformat(timespec="microseconds"),
        id=str(id_),
        key_type=schema[columns.key].dataType.simpleString(),
        id_type=schema[columns.id].dataType.simpleString(),
    )


@dataclass(frozen=True)
class Bounds:
    rows: int
    null_rows: int
    first: Cursor | None
    last: Cursor | None

    @classmethod
    def of(cls, values: dict[str, Any], schema: T.StructType, columns: CursorColumns) -> Bounds:
        return cls(
            values["rows"],
            values["null_rows"],
            to_cursor(values["first"], schema, columns),
            to_cursor(values["last"], schema, columns),
        )

    def reject_null_rows(self, columns: CursorColumns) -> None:
        if self.null_rows:
            raise ValueError(
                f"{self.null_rows} rows have a NULL {columns.key!r} or {columns.id!r}; "
                "use null_keys='skip' to leave them out"
            )


def slice_bounds(df: DataFrame, columns: CursorColumns) -> Bounds:
    """One pass over the two cursor columns."""
    row = df.agg(*bounds_aggregates(df.schema, columns)).first()
    return Bounds.of(row.asDict(), df.schema, columns)


def later(a: Cursor | None, b: Cursor | None) -> Cursor | None:
    """A checkpoint never moves back, also when an overlap read ends before it."""
    if a is None or b is None:
        return b or a
    return b if b.order() >= a.order() else a
