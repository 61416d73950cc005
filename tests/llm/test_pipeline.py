"""The corpus pipeline, stage by stage, and the queries against their SQL."""

from __future__ import annotations

import os
import sys

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marts.llm import queries, workers

from test_operators import brute_components, brute_leaks

TABLES = ("documents", "pages", "benchmark", "conversations")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_its_sql(spark, small, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    df = queries.QUERIES[name](spark, small)
    columns = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, df.select(*columns).collect()), key=repr) == sorted(want, key=repr)


def test_stages_match_brute_force(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    odd = [(9001, None), (9002, "123 456"), (9003, ""), (9004, "le " * 30_000)]
    first = docs.limit(1).collect()[0]
    more = spark.createDataFrame([(i, t, None, "s", 0) for i, t in odd] + [(9005, first.text, "en", "s", 0)], docs.schema)
    docs = docs.unionByName(more)
    columns = docs.columns
    texts = {r.doc_id: r.text for r in docs.collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / name)
        stage(spark, docs, small).write.parquet(path)
        docs = spark.read.parquet(path)
        if name == "language_id":
            want = set(texts) - {9001, 9002, 9003}
        elif name == "exact_dedup":
            want = set({t: d for d, t in sorted(texts.items())}.values())
        elif name == "jaccard_join":
            ids = sorted(texts)
            want = {ids[k] for k, _, c in brute_components([texts[d] for d in ids]) if k == c}
        elif name == "decontamination":
            want = set(texts) - {d for d, *_ in brute_leaks(list(texts.items()), items)}
        else:
            want = set(texts)
        assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == want, name
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
            texts = {r.doc_id: r.text for r in docs.collect()}
    assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").isEmpty()


def test_stages_on_an_empty_table(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
        assert docs.count() == 0, name


def test_batches_stay_bounded_when_the_caller_runs_a_stage(spark, small):
    def batch_bytes(batches):
        for batch in batches:
            yield pa.record_batch({"n": pa.array([batch.nbytes], pa.int64())})

    text = F.concat(F.lit("word "), F.repeat(F.concat(F.lit("alpha beta "), "id", F.lit(" ")), 200))
    docs = spark.range(0, 4_000, numPartitions=1).select(
        F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source")
    )
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    for name, stage in corpus_pipeline.STAGES:
        if name in ("language_id", "decontamination"):
            spark.conf.unset(bound)
            found = stage(spark, docs, small).mapInArrow(batch_bytes, "n long").agg(F.max("n")).first()[0]
            assert found < 2 * workers.BATCH_BYTES, name
    # A bound that the session already has is left alone.
    spark.conf.set(bound, str(workers.BATCH_BYTES // 2))
    workers.bound_batches(spark)
    assert spark.conf.get(bound) == str(workers.BATCH_BYTES // 2)
    spark.conf.unset(bound)


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="reads /proc, needs glibc's malloc_trim")
def test_lean_tasks_keep_no_freed_memory():
    def used() -> float:
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 1e6

    pins: list[bytes] = []  # live pieces between freed ones: the C library does not shrink its heap by itself

    def task(batches):
        for batch in batches:
            held = [b"x" * 60_000 for _ in range(2_000)]
            pins.extend(held[::200])
            del held
            yield batch

    batch = pa.record_batch({"n": pa.array([1], pa.int64())})
    before = used()
    assert list(workers.lean(task)(iter([batch, batch]))) == [batch, batch]
    assert used() - before < 40
