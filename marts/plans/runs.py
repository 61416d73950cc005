"""Run history: one row per attempt, append-only."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.aggregates import last_per_group
from .storage import Folder

SCHEMA = (
    "job_id string, run_id string, started_at timestamp, finished_at timestamp, "
    "status string, rows_read bigint, rows_written bigint, error_message string"
)
_COLUMNS = [column.split()[0] for column in SCHEMA.split(", ")]


class RunHistory:
    """Each attempt is one small JSON file of its own, so concurrent jobs never
    share a write; ``job_id`` is a partition column, so one job's runs prune."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.folder = Folder(spark, f"{root.rstrip('/')}/_runs")

    def append(
        self,
        job_id: str,
        status: str,
        started_at: datetime,
        rows_read: int,
        rows_written: int,
        error: str | None = None,
        finished_at: datetime | None = None,
    ) -> str:
        run_id = uuid.uuid4().hex
        record = {
            "started_at": started_at.isoformat(),
            "finished_at": (finished_at or datetime.now(timezone.utc)).isoformat(),
            "status": status,
            "rows_read": rows_read,
            "rows_written": rows_written,
            "error_message": error or None,
        }
        self.folder.publish(f"job_id={job_id}/{run_id}.json", json.dumps({"run_id": run_id, **record}))
        return run_id

    def read(self, job_id: str | None = None) -> DataFrame:
        """All runs, or one job's: its folder is then the only one listed."""
        part = f"job_id={job_id}" if job_id else ""
        if not self.folder.entries(part):
            return self.spark.createDataFrame([], SCHEMA)
        reader = self.spark.read.schema(SCHEMA).option("basePath", self.folder.root)
        return reader.json(self.folder.at(part)).select(*_COLUMNS)

    def latest(self, job_id: str, limit: int = 50) -> DataFrame:
        """The job's last runs, newest first."""
        return latest_runs(self.read(job_id), job_id, limit)

    def reset(self) -> None:
        """Forget all runs."""
        self.folder.delete("")

    def last_of_every_job(self) -> DataFrame:
        return last_per_group(self.read(), ["job_id"], ["started_at", "run_id"])


def latest_runs(runs: DataFrame, job_id: str, limit: int = 50) -> DataFrame:
    if not 1 <= limit <= 500:
        raise ValueError("limit must be between 1 and 500")
    ordered = runs.where(F.col("job_id") == job_id).orderBy(F.desc("started_at"), F.desc("run_id"))
    return ordered.limit(limit)


def error_summary(runs: DataFrame, characters: int = 200, most: int = 1000) -> DataFrame:
    """Length and head of each run's error text, of which this view shows ``most``
    characters; the stored text is whole."""
    text = F.substring("error_message", 1, most)
    return runs.select(
        "run_id",
        "status",
        F.length(text).alias("error_length"),
        F.substring(text, 1, characters).alias("error_head"),
    )
