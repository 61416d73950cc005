"""Keyed upsert as DataFrame operations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SENT = "_sent"


def free_name(name: str, taken: Sequence[str]) -> str:
    """``name``, with underscores in front until no column has it, in any case."""
    used = {column.lower() for column in taken}
    while name.lower() in used:
        name = f"_{name}"
    return name


def _orderable(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.StructType):
        return all(_orderable(field.dataType) for field in dtype.fields)
    if isinstance(dtype, T.ArrayType):
        return _orderable(dtype.elementType)
    return not isinstance(dtype, (T.MapType, T.VariantType))


def latest_rows(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str] = (),
    counters: Mapping[str, Column] | None = None,
    sent: str = SENT,
) -> DataFrame:
    """One row per key: the last by ``order``, ties broken by the other columns,
    so a rerun picks the same row.

    Adds ``sent`` (rows the key had) and any ``counters``. The maximum of a
    struct is combined before the shuffle: a key with a third of all rows sends
    one row per task.
    """
    values = [name for name in df.columns if name not in key]
    ranked = [name for name in order if name in values]
    rest = [name for name in values if name not in ranked]
    counters = {sent: F.count(F.lit(1)), **(counters or {})}
    counts = [column.alias(name) for name, column in counters.items()]
    grouped = df.groupBy(*key)
    if not values:
        return grouped.agg(*counts)
    row = F.struct(*ranked, *rest)
    if all(_orderable(df.schema[name].dataType) for name in values):
        picked = F.max(row)
    elif ranked:
        picked = F.max_by(row, F.struct(*ranked))
    else:
        picked = F.any_value(row)
    best = free_name("_row", [*df.columns, *counters])
    return grouped.agg(picked.alias(best), *counts).select(
        *[F.col(name) if name in key else F.col(f"{best}.{name}") for name in df.columns], *counters
    )


def upsert_rows(
    old: DataFrame, new: DataFrame, key: Sequence[str], order: Sequence[str] = ()
) -> DataFrame:
    """``old`` with the rows of ``new`` inserted or updated; both unique by key.

    A column of ``new`` overwrites, NULL included; a column only ``old`` has
    keeps its value; a column only ``new`` has is added. If both sides have the
    ``order`` columns, an old row that ranks higher stays as it is.
    """
    left = old.select([F.col(name).alias(f"o_{name}") for name in old.columns])
    right = new.select(
        [F.col(name).alias(f"n_{name}") for name in new.columns] + [F.lit(True).alias("_new")]
    )
    matched = F.lit(True)
    for name in key:
        matched = matched & (F.col(f"o_{name}") == F.col(f"n_{name}"))
    joined = left.join(right, matched, "full_outer")
    if order and all(name in old.columns and name in new.columns for name in order):
        rank = lambda side: F.struct(*(F.col(f"{side}_{name}") for name in order))
        inserted = F.col(f"o_{key[0]}").isNull()
        newer = F.col("_new") & (inserted | (rank("n") >= rank("o")))
        joined = joined.withColumn("_new", newer)
    columns = []
    for name in [*old.columns, *[c for c in new.columns if c not in old.columns]]:
        if name in key:
            value = F.coalesce(F.col(f"n_{name}"), F.col(f"o_{name}"))
        elif name not in new.columns:
            value = F.col(f"o_{name}")
        elif name not in old.columns:
            value = F.when(F.col("_new"), F.col(f"n_{name}"))
        else:
            value = F.when(F.col("_new"), F.col(f"n_{name}")).otherwise(F.col(f"o_{name}"))
        columns.append(value.alias(name))
    return joined.select(*columns)
