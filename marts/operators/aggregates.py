"""Aggregates, top-n reads and row counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rating_aggregate(
    df: DataFrame, key: str, rating: str, average_type: str = "double"
) -> DataFrame:
    """``avg_rating`` and ``rating_count`` per key; an average the type cannot
    hold raises."""
    return df.groupBy(key).agg(
        F.avg(rating).cast(average_type).alias("avg_rating"),
        F.count(F.lit(1)).cast("int").alias("rating_count"),
    )


def table_counts(frames: Mapping[str, DataFrame]) -> DataFrame:
    """One row ``(table, rows)`` per frame."""
    if not frames:
        raise ValueError("no tables to count")
    counts = [
        frame.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        for name, frame in frames.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def top_rows(df: DataFrame, order: Sequence[str | Column], limit: int) -> DataFrame:
    """First ``limit`` rows; plain names sort ascending with NULLs last."""
    keys = [F.asc_nulls_last(key) if isinstance(key, str) else key for key in order]
    return df.orderBy(*keys).limit(limit)


def oldest_row(df: DataFrame, time: str, id_: str) -> DataFrame:
    """The row touched longest ago; a NULL time counts as oldest."""
    return df.orderBy(F.asc_nulls_first(time), F.asc_nulls_last(id_)).limit(1)


def last_per_group(df: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The whole last row of every group, without a window sort."""
    rest = [name for name in df.columns if name not in group]
    last = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*group).agg(last.alias("_row")).select(
        *[F.col(name) if name in group else F.col(f"_row.{name}") for name in df.columns]
    )
