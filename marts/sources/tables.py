"""Source tables: anything Spark can read, under the name a query uses."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def register_views(spark: SparkSession, frames: Mapping[str, DataFrame]) -> None:
    """Temporary views for one-part names; the frames may come from any reader."""
    for name, frame in frames.items():
        frame.createOrReplaceTempView(name)


def register_folder(spark: SparkSession, folder: str, names: Iterable[str]) -> None:
    register_views(spark, {name: read_table(spark, folder, name) for name in names})


def register_table(
    spark: SparkSession, name: str, path: str, source: str = "parquet", **options: str
) -> None:
    """External catalog table for a ``schema.table`` name over existing files."""
    if "." in name:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name.split('.')[0]}`")
    quoted = ".".join(f"`{part}`" for part in name.split("."))
    spark.catalog.createTable(quoted, path=path, source=source, **options)
