"""A GROUP BY that is brought up to date from the rows that changed."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .merge import free_name


@dataclass(frozen=True)
class GroupBy:
    """Group columns and named SQL aggregates over the rows of a job's query."""

    keys: tuple[str, ...]
    aggregates: Mapping[str, str]

    def __post_init__(self) -> None:
        if not self.keys or not self.aggregates:
            raise ValueError("grouping needs keys and aggregates")
        twice = {k.lower() for k in self.keys} & {a.lower() for a in self.aggregates}
        if twice:
            raise ValueError(f"{sorted(twice)} are both keys and aggregates")

    def of(self, rows: DataFrame) -> DataFrame:
        values = [F.expr(sql).alias(name) for name, sql in self.aggregates.items()]
        return rows.groupBy(*self.keys).agg(*values)

    def affected(self, source: DataFrame, changed: DataFrame) -> DataFrame:
        """All rows of ``source`` in a group that has a row in ``changed``; NULL keys match."""
        names = [free_name(f"_changed_{i}", source.columns) for i in range(len(self.keys))]
        # Combined before the shuffle: a hot group is one row a task.
        keys = changed.select(*(F.col(k).alias(n) for k, n in zip(self.keys, names, strict=True))).distinct()
        same = F.lit(True)
        for key, name in zip(self.keys, names, strict=True):
            same = same & F.col(key).eqNullSafe(F.col(name))
        return source.join(keys, same, "left_semi")
