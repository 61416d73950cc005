"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character Python's str.strip() removes, derived from the rule itself.
# U+3000 is the last one.
WHITESPACE = "".join(chr(code) for code in range(0x3001) if chr(code).isspace())

# Fixed value.
TITLE_PREFIX = "TRANSFORMED_"


def strip(text: Column) -> Column:
    """Python's ``str.strip()``. Spark's ``trim`` removes blanks only."""
    return F.btrim(text, F.lit(WHITESPACE))


def normalized_title(title: Column) -> Column:
    """Prefix and strip a non-empty title; NULL and ``''`` stay as they are."""
    return F.when(
        F.length(title) > 0, F.concat(F.lit(TITLE_PREFIX), strip(title))
    ).otherwise(title)


def text_or_empty(value: Column) -> Column:
    """The value as text, ``''`` for NULL."""
    return F.coalesce(value.cast("string"), F.lit(""))
