"""Compare a source with its target."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .merge import free_name


def summary(source: DataFrame, target: DataFrame, control: str) -> DataFrame:
    """One row per side: row count, lowest and highest ``control`` value."""

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.agg(
            F.count(F.lit(1)).alias("rows"),
            F.min(control).alias("lowest"),
            F.max(control).alias("highest"),
        ).select(F.lit(name).alias("side"), "rows", "lowest", "highest")

    return side(source, "source").unionByName(side(target, "target"))


#: Parts of the keys that are compared by digest first.
PARTS = 4096


def key_differences(
    source: DataFrame,
    target: DataFrame,
    key: Sequence[str],
    columns: Sequence[str] = (),
    parts: int = PARTS,
) -> DataFrame:
    """Keys on one side only, and keys whose ``columns`` differ.

    ``difference`` is ``missing`` (not in the target), ``extra`` (not in the
    source) or ``changed``. The keys are dealt into ``parts`` by hash; a part whose
    rows have the same count and the same two 64-bit digest sums on both sides is
    equal and goes no further, so equal sides shuffle one row per part and task. Rows of
    the other parts are grouped, not joined, so a key that a raw source repeats costs one
    row per task; its lowest and highest rows are compared.
    """
    if parts < 1:
        raise ValueError("parts must be positive")
    side, part = free_name("_side", [*key, *columns]), free_name("_part", [*key, *columns])
    sides = source.select(*key, *columns, F.lit("source").alias(side)).unionByName(
        target.select(*key, *columns, F.lit("target").alias(side))
    )
    sides = sides.withColumn(part, F.pmod(F.xxhash64(*key), F.lit(parts)))
    # At most `parts` rows, whatever the sides hold.
    unequal = F.broadcast(_unequal_parts(sides, side, part, [*key, *columns]))
    return _compared(sides.join(unequal, part, "left_semi"), side, key, columns)


def _unequal_parts(sides: DataFrame, side: str, part: str, row: Sequence[str]) -> DataFrame:
    sign = F.when(F.col(side) == "source", 1).otherwise(-1)
    digest = lambda seed: (
        F.xxhash64(F.lit(seed), *row).cast("decimal(20,0)") * sign.cast("decimal(1,0)")
    )
    sums = sides.groupBy(part).agg(
        F.sum(sign).alias("n"), F.sum(digest(1)).alias("a"), F.sum(digest(2)).alias("b")
    )
    return sums.where("n <> 0 OR a <> 0 OR b <> 0").select(part)


def _compared(sides: DataFrame, side: str, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    there = {name: F.col(side) == F.lit(name) for name in ("source", "target")}
    row = F.struct(F.lit(True).alias("_there"), *columns)
    grouped = sides.groupBy(*key).agg(
        *[pick(F.when(there[name], row)).alias(f"_{pick.__name__}_{name}")
          for name in there for pick in (F.min, F.max)]
    )
    difference = (
        F.when(F.col("_max_target").isNull(), F.lit("missing"))
        .when(F.col("_max_source").isNull(), F.lit("extra"))
        .when(
            (F.col("_min_source") != F.col("_min_target"))
            | (F.col("_max_source") != F.col("_max_target")),
            F.lit("changed"),
        )
    )
    return grouped.select(*key, difference.alias("difference")).where(
        F.col("difference").isNotNull()
    )
