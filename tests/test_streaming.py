from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from marts.operators import normalize_title
from marts.plans import MartTable, TargetSpec
from marts.streaming import file_stream, start_upsert

T0 = datetime(2024, 1, 1)
SCHEMA = "id int, title string, at timestamp_ntz"
ITEMS = TargetSpec("items", ("id",), "id INT NOT NULL, title STRING", buckets=2)


def put(spark, root, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/in")


def drain(spark, root, table, **options):
    stream = file_stream(spark, f"{root}/in", SCHEMA, max_files=1)
    query = start_upsert(stream, table, "s", f"{root}/checkpoint", order=("at",), **options)
    query.awaitTermination()
    return [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]


def items(table):
    return sorted(tuple(r) for r in table.read().collect())


def test_stream_upsert(spark, root):
    table = MartTable(spark, root, ITEMS)
    put(spark, root, [(1, "a", T0), (1, "b", T0 + timedelta(1)), (2, "c", T0)])
    put(spark, root, [(2, "d", T0), (3, "e", T0)])
    assert drain(spark, root, table, steps=(normalize_title,)) == [3, 2]
    assert items(table) == [
        (1, "TRANSFORMED_b"), (2, "TRANSFORMED_d"), (3, "TRANSFORMED_e")
    ]
    assert table.manifest().streams == {"s": 1}
    # Only new files are read by the next run.
    put(spark, root, [(3, "f", T0)])
    assert drain(spark, root, table) == [1]
    assert items(table)[2] == (3, "f")


def test_replayed_batch_is_skipped(spark, root, monkeypatch):
    """Crash after the publish, before Spark notes the batch as done."""
    table = MartTable(spark, root, ITEMS)
    put(spark, root, [(1, "a", T0)])
    original = MartTable.publish

    def crash(self, *args, **kwargs):
        original(self, *args, **kwargs)
        raise OSError("lost")

    monkeypatch.setattr(MartTable, "publish", crash)
    with pytest.raises(Exception, match="lost"):
        drain(spark, root, table)
    monkeypatch.undo()
    version = table.manifest().version
    drain(spark, root, table)
    assert table.manifest().version == version and items(table) == [(1, "a")]


def test_failed_batch_is_repeated(spark, root, monkeypatch):
    table = MartTable(spark, root, ITEMS)
    put(spark, root, [(1, "a", T0)])

    def crash(self, *args, **kwargs):
        raise OSError("lost")

    monkeypatch.setattr(MartTable, "publish", crash)
    with pytest.raises(Exception, match="lost"):
        drain(spark, root, table)
    monkeypatch.undo()
    assert table.versions() == []
    drain(spark, root, table)
    assert items(table) == [(1, "a")]
