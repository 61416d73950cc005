"""Batch transforms: ``DataFrame -> DataFrame`` functions and opaque Python."""

from __future__ import annotations

import asyncio
import inspect
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from functools import reduce
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.text import normalized_title, text_or_empty

Transform = Callable[[DataFrame], DataFrame]


def apply_steps(df: DataFrame, steps: Sequence[Transform]) -> DataFrame:
    """The steps in order, as one lazy plan; no step is the no-op transform.

    A step must be row-local (map, filter, explode): grouping belongs in the
    source query, where it sees every row.
    """
    return reduce(lambda frame, step: frame.transform(step), steps, df)


def normalize_title(df: DataFrame) -> DataFrame:
    """Prefix and strip ``title`` where it is non-empty."""
    if "title" not in df.columns:
        return df
    return df.withColumn("title", normalized_title(F.col("title")))


def film_dim(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``film_id``, ``title`` as text, ``rating`` as double; NULL where absent.

    ``keep`` names further columns to carry, such as a cursor key that decides
    which of two equal keys is the later one.
    """

    def column(name: str):
        return F.col(name) if name in df.columns else F.lit(None)

    return df.select(
        F.col("film_id"),
        text_or_empty(column("title")).alias("title"),
        column("rating").cast("double").alias("rating"),
        *keep,
    )


def pandas_transform(
    fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str | T.StructType
) -> Transform:
    """A pandas function over Arrow batches; it may drop, change or add rows."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield fn(frame)

    return lambda df: df.mapInPandas(batches, schema)


def _takes(fn: Callable[..., Any], name: str) -> bool:
    try:
        parameters = inspect.signature(fn).parameters.values()
    except (TypeError, ValueError):  # some built-in functions tell nothing
        return False
    named = (inspect.Parameter.KEYWORD_ONLY, inspect.Parameter.POSITIONAL_OR_KEYWORD)
    return any(
        p.kind == inspect.Parameter.VAR_KEYWORD or (p.name == name and p.kind in named) for p in parameters
    )


def rows_transform(
    fn: Callable[..., Any], schema: str | T.StructType, pipeline: Mapping[str, Any] | None = None
) -> Transform:
    """A ``rows -> rows`` function (sync or async) over batches of dicts.

    ``pipeline`` is a small mapping about the job; a function with a parameter of that
    name, or with ``**`` ones, is called as ``fn(rows, pipeline=...)``, others without.

    The escape hatch for existing row code: batches travel as Arrow and hold
    ``spark.sql.execution.arrow.maxRecordsPerBatch`` rows. The result may be any
    iterable of mappings; columns missing from a row become NULL.
    """
    target = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow_schema = to_arrow_schema(target)
    passed = {"pipeline": dict(pipeline or {})} if _takes(fn, "pipeline") else {}

    # Both are local, so that they reach the workers by value.
    async def resolved(awaitable: Any) -> Any:
        return await awaitable

    def batches(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in records:
            if not batch.num_rows:
                continue
            result = fn(batch.to_pylist(), **passed)
            if inspect.isawaitable(result):
                result = asyncio.run(resolved(result))
            if isinstance(result, (str, bytes, Mapping)) or not isinstance(result, Iterable):
                raise TypeError(f"a transform must return rows, got {type(result).__name__}")
            rows = [dict(row) for row in result]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow_schema)

    return lambda df: df.mapInArrow(batches, target)
