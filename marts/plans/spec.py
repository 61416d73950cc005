"""Target and job definitions: small frozen values on the driver."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..operators.cursor import CursorColumns
from ..operators.groups import GroupBy

_NAME = re.compile(r"[A-Za-z0-9_][A-Za-z0-9_.\-]*")


def _check_name(name: str) -> None:
    if not _NAME.fullmatch(name or ""):
        raise ValueError(f"not a usable name: {name!r}")


@dataclass(frozen=True)
class TargetSpec:
    """A keyed target.

    ``mode='replace'``: fixed ``schema``; the rows are projected onto it and a
    matching row is overwritten as a whole. ``required`` columns must be
    present (all of ``schema`` but ``load_time`` if not given).
    ``mode='merge'``: documents; columns present in the rows overwrite, absent
    ones keep their value. ``schema`` may be partial or missing: other columns
    are added as they come.

    ``NOT NULL`` columns of ``schema`` and ``rules`` (SQL conditions) are checked
    on every row before anything is published.
    """

    name: str
    key: tuple[str, ...]
    schema: str | None = None
    mode: str = "replace"
    required: tuple[str, ...] | None = None
    load_time: str | None = None
    rules: Mapping[str, str] = field(default_factory=dict)
    buckets: int | None = None

    def __post_init__(self) -> None:
        _check_name(self.name)
        if self.mode not in ("replace", "merge"):
            raise ValueError(f"unknown mode {self.mode!r}")
        if not self.key:
            raise ValueError("a target needs a key")
        if self.mode == "replace" and self.schema is None:
            raise ValueError("a replace target needs a schema")
        if self.buckets is not None and (self.buckets < 1 or self.buckets & (self.buckets - 1)):
            raise ValueError("buckets must be a power of two")

    def struct(self) -> T.StructType | None:
        """The parsed schema; needs a session, unlike the definition itself."""
        return T.StructType.fromDDL(self.schema) if self.schema else None

    def required_columns(self) -> tuple[str, ...]:
        if self.required is not None:
            return self.required
        return tuple(name for name in self.struct().names if name != self.load_time)


@dataclass(frozen=True)
class Step:
    """A row-local transform; the last one may name another target."""

    transform: Callable[[DataFrame], DataFrame]
    target: TargetSpec | None = None


@dataclass(frozen=True)
class JobSpec:
    """One query, optional steps, one keyed target.

    ``order`` decides which of several rows with one key is the last; an
    incremental job uses its cursor columns when the steps keep them. Without an
    order a repeated key is an error.

    ``max_rows`` cuts the backlog into slices that are committed one by one.
    The backlog is then written once, ordered, and read from there, so that the
    source is evaluated once a run. ``stage_backlog=False`` leaves that out: every
    slice reads the source again through a range filter, which suits sources laid
    out by the cursor key.

    ``group_by`` aggregates the query's rows before the steps. An incremental job then
    takes the groups of the rows past the cursor and computes those anew from all
    their rows; other groups are neither aggregated nor written.
    """

    job_id: str
    query: str
    target: TargetSpec
    mode: str = "full"
    cursor: CursorColumns | None = None
    steps: tuple[Step | Callable[[DataFrame], DataFrame], ...] = ()
    order: tuple[str, ...] = ()
    max_rows: int | None = None
    stage_backlog: bool | None = None
    overlap: timedelta | None = None
    null_keys: str = "error"
    group_by: GroupBy | None = None

    def __post_init__(self) -> None:
        _check_name(self.job_id)
        if self.mode not in ("full", "incremental"):
            raise ValueError(f"unknown mode {self.mode!r}")
        if self.mode == "incremental" and self.cursor is None:
            raise ValueError("an incremental job needs cursor columns")
        if self.mode == "full" and (self.max_rows or self.overlap or self.stage_backlog):
            raise ValueError("max_rows, overlap and stage_backlog need mode='incremental'")
        if self.max_rows is not None and self.max_rows < 1:
            raise ValueError("max_rows must be positive")
        if self.overlap is not None and self.overlap < timedelta(0):
            raise ValueError("overlap must not be negative")
        if self.null_keys not in ("error", "skip"):
            raise ValueError("null_keys is 'error' or 'skip'")
        for step in self.steps:
            if not callable(step) and not isinstance(step, Step):
                raise ValueError(f"a step must be a function, got {step!r}")
        for step in self.steps[:-1]:
            if isinstance(step, Step) and step.target is not None:
                raise ValueError("only the last step may override the target")

    def transforms(self) -> list[Callable[[DataFrame], DataFrame]]:
        return [step.transform if isinstance(step, Step) else step for step in self.steps]

    def stages(self) -> bool:
        """Whether the backlog is written aside before it is cut."""
        return self.max_rows is not None if self.stage_backlog is None else self.stage_backlog

    def final_target(self) -> TargetSpec:
        last = self.steps[-1] if self.steps else None
        return (last.target if isinstance(last, Step) else None) or self.target
