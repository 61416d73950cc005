"""Values as a JSON document holds them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SECONDS = "yyyy-MM-dd'T'HH:mm:ss"
_MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def utc_wall_clock(ts: Column) -> Column:
    """UTC wall-clock reading of a TIMESTAMP, whatever the session time zone."""
    seconds = (F.unix_micros(ts).cast("decimal(20,0)") / F.lit(1_000_000)).cast("decimal(18,6)")
    epoch = F.lit("1970-01-01T00:00:00").cast("timestamp_ntz")
    return epoch + F.make_dt_interval(secs=seconds)


def iso_text(ts: Column, dtype: T.DataType) -> Column:
    """ISO-8601 text: the fraction appears only when it is not zero, the offset
    only for zone-aware timestamps (always UTC)."""
    if isinstance(dtype, T.DateType):
        return F.date_format(ts, "yyyy-MM-dd")
    zoned = isinstance(dtype, T.TimestampType)
    wall = utc_wall_clock(ts) if zoned else ts
    has_fraction = F.date_format(wall, "SSSSSS") != F.lit("000000")
    text = F.when(has_fraction, F.date_format(wall, _MICROS)).otherwise(
        F.date_format(wall, _SECONDS)
    )
    return F.concat(text, F.lit("+00:00")) if zoned else text


def jsonify(df: DataFrame, skip: Sequence[str] = ()) -> DataFrame:
    """Top-level columns as JSON-safe values: decimals become doubles, dates and
    timestamps ISO text; NULL, every other type and ``skip`` stay as they are."""
    columns = []
    for field in df.schema.fields:
        column = df[field.name]
        if field.name in skip:
            pass
        elif isinstance(field.dataType, T.DecimalType):
            column = column.cast("double")
        elif isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            column = iso_text(column, field.dataType)
        columns.append(column.alias(field.name))
    return df.select(*columns)


def document_id(key: Column) -> Column:
    """The document id: the key as text. NULL stays NULL, so the key check finds it."""
    return key.cast("string")
