"""Continuous upsert of an append-only file source."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.transforms import apply_steps
from ..plans.target import MartTable


def file_stream(
    spark: SparkSession,
    path: str,
    schema: str | T.StructType,
    max_files: int | None = None,
    source: str = "parquet",
) -> DataFrame:
    """New files of a folder; ``max_files`` bounds one micro-batch."""
    reader = spark.readStream.format(source).schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def start_upsert(
    stream: DataFrame,
    table: MartTable,
    stream_id: str,
    checkpoint: str,
    order: Sequence[str] = (),
    steps: Sequence[Callable[[DataFrame], DataFrame]] = (),
    available_now: bool = True,
    interval: str | None = None,
    now: datetime | None = None,
) -> StreamingQuery:
    """Upsert every micro-batch into ``table``.

    The batch number is published with the data, so a batch Spark replays after
    a failure is skipped if it had been committed. ``order`` decides between
    rows of one key within a batch. Where the target stores its columns unchanged it
    also decides against the stored row, so files may come late; where it does not,
    the later batch wins.
    ``checkpoint`` and ``stream_id`` belong together: a new checkpoint folder
    needs a new id.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        if table.manifest().streams.get(stream_id, -1) >= batch_id:
            return
        staged = table.stage(apply_steps(batch, steps), order, now)
        table.publish(staged, stream=(stream_id, batch_id))

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    if interval:
        writer = writer.trigger(processingTime=interval)
    elif available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
