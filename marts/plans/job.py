"""Run a job: read, transform, upsert, advance the checkpoint, record the run."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from datetime import datetime, timezone
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.cursor import (
    Bounds,
    Cursor,
    backlog,
    bounds_aggregates,
    check_cursor_columns,
    later,
    slice_bounds,
)
from ..operators.slices import Slice, plan_slices
from ..operators.transforms import apply_steps
from ..session import new_folder
from ..sources.query import sql_source
from .runs import RunHistory
from .spec import JobSpec
from .storage import Folder
from .target import MartTable, Staged


@dataclass
class RunResult:
    """``rows_read`` comes from an observed metric: Spark may count a row twice
    when it repeats a lost task. Everything that decides data or checkpoints is
    taken from written rows."""

    job_id: str
    rows_read: int = 0
    rows_written: int = 0
    slices: int = 0
    version: int = 0
    cursor: Cursor | None = None
    stopped: bool = False
    run_id: str | None = None


def run_job(
    spark: SparkSession,
    job: JobSpec,
    root: str,
    params: Mapping[str, Any] | None = None,
    now: datetime | None = None,
    should_stop: Callable[[], bool] | None = None,
) -> RunResult:
    """One attempt. ``should_stop`` is asked after every committed slice; a
    stopped incremental job resumes from its checkpoint."""
    now = now or datetime.now(timezone.utc)
    started = datetime.now(timezone.utc)
    result = RunResult(job.job_id)
    history = RunHistory(spark, root)
    try:
        table = MartTable(spark, root, job.final_target())
        source = sql_source(spark, job.query, params)
        if job.mode == "full":
            _load_all(job, table, source, now, result)
        else:
            _load_backlog(job, table, source, now, should_stop or (lambda: False), result)
    except Exception as error:
        history.append(
            job.job_id, "FAILED", started, result.rows_read, result.rows_written,
            f"{type(error).__name__}: {error}",
        )
        raise
    result.run_id = history.append(
        job.job_id, "SUCCESS", started, result.rows_read, result.rows_written
    )
    return result


def _load_all(
    job: JobSpec, table: MartTable, source: DataFrame, now: datetime, result: RunResult
) -> None:
    seen = Observation()
    rows = source.observe(seen, F.count(F.lit(1)).alias("rows"))
    if job.group_by is not None:
        rows = job.group_by.of(rows)
    staged = table.stage(apply_steps(rows, job.transforms()), job.order, now)
    observed = _observed(seen)
    result.rows_read = observed["rows"] if observed else source.count()
    published = table.publish(staged)
    result.rows_written = published.rows_written
    result.version = published.version
    result.slices = 1


def _load_backlog(
    job: JobSpec,
    table: MartTable,
    source: DataFrame,
    now: datetime,
    should_stop: Callable[[], bool],
    result: RunResult,
) -> None:
    columns = job.cursor
    check_cursor_columns(source.schema, columns)
    position = table.cursor(job.job_id)
    if position is not None:
        _check_types(position, source, job)
    pending = backlog(
        source, columns, position, job.overlap, keep_null_rows=job.null_keys == "error"
    )
    result.cursor = position
    result.version = table.manifest().version
    staging = Folder(table.spark, new_folder(table.spark, "backlog")) if job.stages() else None
    try:
        if staging is not None:
            pending = _stage_backlog(pending, job, staging)
        for piece in _pieces(pending, job):
            staged, bounds = _stage_piece(table, job, source, pending, piece, now)
            bounds.reject_null_rows(columns)
            if not bounds.rows:
                continue
            start, position = position, later(position, bounds.last)
            # The checkpoint follows what was read, also when the steps
            # dropped every row.
            published = table.publish(staged, job.job_id, start, position)
            result.rows_read += bounds.rows
            result.rows_written += published.rows_written
            result.slices += 1
            result.version = published.version
            result.cursor = position
            if should_stop():
                result.stopped = True
                return
    finally:
        if staging is not None:
            staging.delete("")


def _stage_piece(
    table: MartTable,
    job: JobSpec,
    source: DataFrame,
    pending: DataFrame,
    piece: Slice | None,
    now: datetime,
) -> tuple[Staged, Bounds]:
    """Stage one slice (``None``: all that is pending) and tell what was read, in
    the same pass over the pending rows."""
    columns = job.cursor
    rows = pending if piece is None else piece.of(pending, columns)
    seen = Observation()
    observed = rows.observe(seen, *bounds_aggregates(rows.schema, columns))
    usable = observed.where(F.col(columns.key).isNotNull() & F.col(columns.id).isNotNull())
    if job.group_by is not None:
        usable = job.group_by.of(job.group_by.affected(source, usable))
    out = apply_steps(usable, job.transforms())

    def nothing_read() -> bool:
        metrics = _observed(seen)
        return bool(metrics) and metrics["rows"] == 0

    staged = table.stage(out, _row_order(job, out), now, nothing_read)
    metrics = _observed(seen)
    if metrics:
        return staged, Bounds.of(metrics, rows.schema, columns)
    if piece is not None:
        return staged, Bounds(slice_bounds(rows, columns).rows, 0, None, piece.hi)
    # Fix the end first and read up to it: rows that arrive meanwhile must stay
    # after the checkpoint.
    bounds = slice_bounds(pending, columns)
    bounds.reject_null_rows(columns)
    if not bounds.rows:
        return staged, bounds
    return _stage_piece(table, job, source, pending, Slice(None, bounds.last, bounds.rows), now)


def _observed(seen: Observation) -> dict[str, Any]:
    """The metrics, or nothing where Spark lost them: adaptive execution drops
    the observed part of a plan whose result turns out empty."""
    try:
        return seen.get
    except Py4JJavaError:
        return {}


def _pieces(pending: DataFrame, job: JobSpec) -> Iterator[Slice | None]:
    if job.max_rows is None:
        yield None
        return
    bounds = slice_bounds(pending, job.cursor)
    bounds.reject_null_rows(job.cursor)
    yield from plan_slices(pending, job.cursor, job.max_rows, bounds)


def _stage_backlog(pending: DataFrame, job: JobSpec, staging: Folder) -> DataFrame:
    """Write the backlog once, ranged by the cursor, so that slices prune it."""
    ranged = pending.repartitionByRange(job.cursor.key, job.cursor.id)
    ordered = ranged.sortWithinPartitions(job.cursor.key, job.cursor.id)
    ordered.write.parquet(staging.root)
    return pending.sparkSession.read.schema(pending.schema).parquet(staging.root)


def _row_order(job: JobSpec, out: DataFrame) -> tuple[str, ...]:
    if job.order:
        return job.order
    pair = (job.cursor.key, job.cursor.id)
    return pair if all(name in out.columns for name in pair) else ()


def _check_types(position: Cursor, source: DataFrame, job: JobSpec) -> None:
    for name, stored in ((job.cursor.key, position.key_type), (job.cursor.id, position.id_type)):
        actual = source.schema[name].dataType.simpleString()
        if actual != stored:
            raise ValueError(f"cursor column {name!r} was {stored}, the query now returns {actual}")
