"""Row rules and key checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def violated(condition: str | Column) -> Column:
    """True where a rule is broken. An unknown (NULL) result passes, as in a SQL
    CHECK; add ``IS NOT NULL`` where NULL must fail."""
    holds = F.expr(condition) if isinstance(condition, str) else condition
    return ~F.coalesce(holds, F.lit(True))


def not_null_rules(schema: T.StructType, skip: Sequence[str] = ()) -> dict[str, str]:
    return {
        f"{field.name} is not null": f"`{field.name}` IS NOT NULL"
        for field in schema.fields
        if not field.nullable and field.name not in skip
    }


def check_rules(df: DataFrame, rules: Mapping[str, str | Column]) -> DataFrame:
    """One row per rule with its number of violations; one pass for all rules."""
    if not rules:
        return df.sparkSession.createDataFrame([], "rule string, violations bigint")
    names = list(rules)
    counted = df.agg(
        *[F.count_if(violated(rules[name])).alias(f"r{i}") for i, name in enumerate(names)]
    )
    entries = [
        F.struct(F.lit(name).alias("rule"), F.col(f"r{i}").alias("violations"))
        for i, name in enumerate(names)
    ]
    return counted.select(F.inline(F.array(*entries)))


def check_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """``null_keys``: rows with a NULL key part; ``duplicate_keys``: keys held by
    more than one row. Counts are combined before the shuffle, so a hot key
    costs one row per task."""
    missing = F.lit(False)
    for name in key:
        missing = missing | F.col(name).isNull()
    per_key = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_rows"))
    return per_key.agg(
        F.coalesce(F.sum(F.when(missing, F.col("_rows"))), F.lit(0)).alias("null_keys"),
        F.count_if(~missing & (F.col("_rows") > 1)).alias("duplicate_keys"),
    )
