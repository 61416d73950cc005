"""Connected components of a link table, in DataFrame functions.

Alternates the large-star and small-star steps: every row links to the least id it
knows of, until nothing changes; a few rounds even for long chains. A vertex with
very many links costs one row per task (minimum before the shuffle), and its rows are
a join's side that adaptive execution can split. Each round is written to the shared
folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marts.session import new_folder


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    # Here every row has a > b.
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def connected_components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """``(id, component)`` of every id in ``links(a, b)``; the component is its least id."""

    def written(df: DataFrame) -> DataFrame:
        folder = new_folder(spark, "links")
        df.where("a <> b").distinct().write.parquet(folder)
        return spark.read.parquet(folder)

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    links = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    before = state(links)
    while before[0]:
        links = written(_small_star(_large_star(links)))
        now = state(links)
        if now == before:
            break
        before = now
    found = links.select(F.col("a").alias("id"), F.col("b").alias("component"))
    roots = links.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return found.unionByName(roots)
