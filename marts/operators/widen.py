"""Types of document fields that nobody declared: each field's type grows with its values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_BROKEN = (T.FloatType, T.DoubleType)
#: Whole numbers up to this are exact as doubles.
EXACT = 1 << 53


def wider(stored: T.DataType, given: T.DataType) -> T.DataType | None:
    """The narrowest type that holds values of both, or nothing.

    int, bigint, double in this order. Text takes any plain value; a text given for a
    number or a truth value stays that type, and the cast raises if it is none. Arrays, maps
    and structs with the same fields grow by their parts.
    """
    if stored == given or isinstance(given, T.NullType):
        return stored
    if isinstance(stored, T.NullType):
        return given
    if isinstance(stored, _WHOLE) and isinstance(given, _WHOLE):
        return max(stored, given, key=lambda t: _WHOLE.index(type(t)))
    if isinstance(stored, _WHOLE + _BROKEN) and isinstance(given, _WHOLE + _BROKEN):
        return T.DoubleType()
    plain = (*_WHOLE, *_BROKEN, T.BooleanType, T.StringType, T.DecimalType)
    if isinstance(stored, plain) and isinstance(given, plain):
        return stored if T.StringType() in (stored, given) else None
    if isinstance(stored, T.ArrayType) and isinstance(given, T.ArrayType):
        element = wider(stored.elementType, given.elementType)
        return element and T.ArrayType(element)
    if isinstance(stored, T.MapType) and isinstance(given, T.MapType):
        value = wider(stored.valueType, given.valueType)
        return value and stored.keyType == given.keyType and T.MapType(stored.keyType, value) or None
    if isinstance(stored, T.StructType) and isinstance(given, T.StructType):
        parts = [wider(a.dataType, b.dataType) for a, b in zip(stored, given, strict=False)]
        if stored.names != given.names or None in parts:
            return None
        return T.StructType([T.StructField(n, t) for n, t in zip(stored.names, parts, strict=True)])
    return None


def grown(stored: T.StructType, given: T.StructType, fixed: frozenset[str] = frozenset()) -> T.StructType:
    """``stored`` with each field of both as wide as ``given`` needs it, but for ``fixed`` ones."""
    fields = []
    for field in stored.fields:
        kind = field.dataType
        if field.name in given.names and field.name not in fixed:
            other = given[field.name].dataType
            kind = wider(kind, other)
            if kind is None:
                raise ValueError(
                    f"field {field.name!r} holds {field.dataType.simpleString()} and cannot take {other.simpleString()}"
                )
        fields.append(T.StructField(field.name, kind, True))
    return T.StructType(fields)


def inexact(value: Column, given: T.DataType, dtype: T.DataType) -> Column | None:
    """Where a whole number would lose digits as a double; nothing if none can."""
    if isinstance(given, T.LongType) and isinstance(dtype, T.DoubleType):
        return (value > EXACT) | (value < -EXACT)
    return None


def exactly(name: str, given: T.DataType, dtype: T.DataType) -> Column:
    """The column as ``dtype``; a number that would lose digits is an error with the field named."""
    value = F.col(f"`{name}`")
    lost = inexact(value, given, dtype)
    if lost is None:
        return value.cast(dtype)
    message = F.concat(F.lit(f"field {name!r} is double and cannot hold "), value.cast("string"))
    return F.when(~F.coalesce(lost, F.lit(False)), value.cast(dtype)).otherwise(F.raise_error(message))


def as_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with the columns of ``schema``; absent ones are NULL."""
    if [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in schema]:
        return df
    given = df.columns
    return df.select(
        *(
            (F.col(f"`{f.name}`") if f.name in given else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        )
    )
