"""Keyed upsert into a catalog table whose format supports MERGE."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.merge import SENT, latest_rows


def merge_into(
    df: DataFrame, table: str, key: Sequence[str], order: Sequence[str] = ()
) -> None:
    """Insert or update ``df`` by key with the table format's own MERGE.

    The columns of ``df`` overwrite, other columns of ``table`` keep their value
    (NULL for new rows). Save the job's cursor after this returns: a repeated
    merge of the same rows changes nothing.
    """
    unique = latest_rows(df, key, order).drop(SENT).alias("incoming")
    matched = reduce(
        lambda left, right: left & right,
        [F.col(f"{table}.{name}") == F.col(f"incoming.{name}") for name in key],
    )
    values = {name: F.col(f"incoming.{name}") for name in df.columns}
    changes = {name: value for name, value in values.items() if name not in key}
    (
        unique.mergeInto(table, matched)
        .whenMatched().update(changes)
        .whenNotMatched().insert(values)
        .merge()
    )
