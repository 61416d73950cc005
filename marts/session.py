"""Session settings and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

# Settings the library is tuned for. Shuffle width is left to the cluster:
# adaptive execution coalesces or splits partitions from measured sizes.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Let adaptive execution pick a hash join where every measured build
    # partition is small; it falls back to sort-merge (which spills) otherwise.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(app_name: str = "marts", master: str | None = None, **conf: str) -> SparkSession:
    """A session with :data:`SETTINGS`; ``conf`` entries win over them."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def require_ansi(spark: SparkSession) -> None:
    """Casts must raise on overflow: a silent NULL would be written as data."""
    if spark.conf.get("spark.sql.ansi.enabled", "true").lower() != "true":
        raise ValueError("spark.sql.ansi.enabled must be true: target casts rely on it")


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables, which driver and executors share.

    It is the one named in ``spark.checkpoint.dir`` or set as checkpoint directory,
    else a folder in the warehouse: one rule for local and cluster sessions.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


def new_folder(spark: SparkSession, name: str) -> str:
    """A path not used before, below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
