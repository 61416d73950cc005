"""Fit rows to a target."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.documents import document_id, iso_text, jsonify
from .widen import exactly


def match_names(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Columns in the spelling of ``names``, by the session's rule on case.

    Columns that differ only by case are an error unless the session tells them
    apart.
    """
    if df.sparkSession.conf.get("spark.sql.caseSensitive", "false").lower() == "true":
        return df
    lower = [name.lower() for name in df.columns]
    twice = sorted({name for name in df.columns if lower.count(name.lower()) > 1})
    if twice:
        raise ValueError(f"columns {twice} differ only by case")
    spelling = {name.lower(): name for name in reversed(names)}
    return df.toDF(*[spelling.get(name.lower(), name) for name in df.columns])


def project(
    df: DataFrame,
    schema: T.StructType,
    required: Sequence[str],
    load_time: str | None = None,
    now: datetime | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Exactly the target's columns, cast to its types.

    A missing required column is an error before anything runs, a missing
    optional one becomes NULL, other columns are dropped. ``load_time`` is set
    to ``now`` and never taken from the rows. ``carry`` columns pass through.
    """
    missing = [name for name in required if name not in df.columns]
    if missing:
        raise ValueError(f"rows lack required columns {missing}; they have {df.columns}")
    columns = []
    for field in schema.fields:
        if field.name == load_time:
            value = F.current_timestamp() if now is None else F.lit(now)
        elif field.name in df.columns:
            value = F.col(field.name)
        else:
            value = F.lit(None)
        columns.append(value.cast(field.dataType).alias(field.name))
    return df.select(*columns, *carry)


def document(
    df: DataFrame,
    schema: T.StructType | None,
    key: Sequence[str],
    carry: Sequence[str] = (),
) -> DataFrame:
    """All columns of the rows as JSON-safe values; those ``schema`` knows are
    cast to its types, a decimal key that it does not know becomes text, digit by digit."""
    missing = [name for name in key if name not in df.columns]
    if missing:
        raise ValueError(f"rows lack the document id {missing}; they have {df.columns}")
    known = {field.name: field.dataType for field in schema.fields} if schema else {}
    ids = [
        name
        for name in key
        if name not in known and isinstance(df.schema[name].dataType, T.DecimalType)
    ]
    body = jsonify(df, skip=[*carry, *known, *ids])
    return body.select(
        *[
            _declared(body, name, known[name])
            if name in known
            else document_id(F.col(name)).alias(name)
            if name in ids
            else F.col(name)
            for name in body.columns
        ]
    )


def _declared(df: DataFrame, name: str, dtype: T.DataType) -> Column:
    """A declared column in its type, from the value itself: a decimal keeps its
    digits, dates and times become text the way documents show them."""
    value, given = F.col(name), df.schema[name].dataType
    if isinstance(dtype, T.StringType) and not isinstance(given, T.StringType):
        shown = jsonify(df.select(name)).schema[name].dataType
        if isinstance(shown, T.StringType):
            value = iso_text(value, given)
            return value.cast(dtype).alias(name)
    return exactly(name, given, dtype).alias(name)
