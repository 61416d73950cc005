"""A SELECT as source."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Type names of the demo queries' dialect that Spark SQL lacks.
CAST_TYPE_NAMES = {
    "float8": "double",
    "float4": "float",
    "int8": "bigint",
    "int4": "int",
    "int2": "smallint",
    "text": "string",
    "uuid": "string",
    "timestamptz": "timestamp",
}
# A number type without digits has any number of them there; here it gets these.
_ANY_NUMERIC = "decimal(38,18)"
_QUOTED_OR_CAST = re.compile(
    r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|--[^\n]*|/\*.*?\*/"
    rf"|::\s*({'|'.join(CAST_TYPE_NAMES)})\b|::\s*(numeric|decimal)\b(?!\s*\()"
    rf"|\bAS\s+({'|'.join(CAST_TYPE_NAMES)})\s*(?=\))|\bAS\s+(numeric|decimal)\s*(?=\))"
    r"|\b(?:TRY_)?CAST\s*\(|\(|\)",
    re.IGNORECASE | re.DOTALL,
)


def spark_cast_names(query: str) -> str:
    """``x::float8`` and ``CAST(x AS float8)`` as double; quoted text and comments
    are left alone, and so is an alias before any other closing parenthesis."""
    casts: list[bool] = []  # of the open parentheses, those of a cast

    def rename(match: re.Match[str]) -> str:
        short, short_numeric, long, long_numeric = match.groups()
        text = match.group(0)
        if short or short_numeric:
            return f"::{CAST_TYPE_NAMES[short.lower()] if short else _ANY_NUMERIC}"
        if (long or long_numeric) and casts and casts[-1]:
            return f"AS {CAST_TYPE_NAMES[long.lower()] if long else _ANY_NUMERIC}"
        if text.endswith("(") and not text.startswith(("'", '"', "-", "/")):
            casts.append(len(text) > 1)
        elif text == ")" and casts:
            casts.pop()
        return text

    return _QUOTED_OR_CAST.sub(rename, query)


def sql_source(
    spark: SparkSession, query: str, params: Mapping[str, Any] | None = None
) -> DataFrame:
    """All rows of ``query``, read once; its output columns are the schema.

    ``params`` fill ``:name`` markers. A trailing ``;`` is dropped.
    """
    body = (query or "").strip().rstrip(";").strip()
    if not body:
        raise ValueError("the source query is empty")
    # The newline keeps a closing line comment from hiding the parenthesis.
    wrapped = f"SELECT * FROM (\n{spark_cast_names(body)}\n) AS src"
    return spark.sql(wrapped, args=dict(params) if params else None)


def ordered_page(
    df: DataFrame, order: Sequence[str | Column], offset: int, limit: int
) -> DataFrame:
    """Rows ``[offset, offset + limit)`` of a total order. For previews: loads
    never page."""
    keys = [F.asc_nulls_last(key) if isinstance(key, str) else key for key in order]
    return df.orderBy(*keys).offset(offset).limit(limit)
