from __future__ import annotations

import random
import subprocess
import sys
from decimal import Decimal

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marts.operators import (
    apply_steps,
    check_keys,
    check_rules,
    film_dim,
    key_differences,
    last_per_group,
    latest_rows,
    normalize_title,
    oldest_row,
    pandas_transform,
    rating_aggregate,
    rows_transform,
    summary,
    table_counts,
    top_rows,
    upsert_rows,
)
from marts.operators.conform import document, project


def test_film_dim_transform(spark):
    df = spark.createDataFrame(
        [("f1", None, Decimal("8.5"), "x"), ("f2", "T", None, "y")],
        "film_id string, title string, rating decimal(3,1), description string",
    )
    assert film_dim(df).collect() == [("f1", "", 8.5), ("f2", "T", None)]
    assert film_dim(df.drop("rating", "title")).collect() == [("f1", "", None), ("f2", "", None)]
    assert film_dim(df, keep=("description",)).columns[-1] == "description"


def test_steps_run_in_order_and_none_is_a_no_op(spark):
    df = spark.createDataFrame([(" a ", 1), ("b", 2)], "title string, n int")
    assert apply_steps(df, []).collect() == df.collect()
    steps = [lambda d: d.where("n = 1"), normalize_title]
    assert apply_steps(df, steps).collect() == [("TRANSFORMED_a", 1)]
    assert normalize_title(df.drop("title")).collect() == [(1,), (2,)]


def test_rows_transform_filters_and_explodes(spark):
    def fn(rows):
        return [{"id": r["id"], "part": p} for r in rows if r["id"] != 2 for p in r["t"].split()]

    df = spark.createDataFrame([(1, "a b"), (2, "c"), (3, "")], "id int, t string")
    out = apply_steps(df, [rows_transform(fn, "id int, part string")])
    assert sorted(out.collect()) == [(1, "a"), (1, "b")]


def test_rows_transform_async_iterables_and_missing_columns(spark):
    async def fn(rows):
        return ({"id": r["id"]} for r in rows)

    df = spark.range(3)
    out = apply_steps(df, [rows_transform(fn, "id bigint, extra decimal(3,1)")])
    assert sorted(out.collect()) == [(0, None), (1, None), (2, None)]


@pytest.mark.parametrize("result", [None, 5, "text", {"id": 1}])
def test_rows_transform_must_return_rows(spark, result):
    step = rows_transform(lambda rows: result, "id bigint")
    with pytest.raises(Exception, match="must return rows"):
        apply_steps(spark.range(1), [step]).collect()


def test_transforms_travel_without_this_package(tmp_path):
    """Workers need not have the library on their path."""

    class Frame:
        def mapInArrow(self, fn, schema):
            return cloudpickle.dumps(fn)

        mapInPandas = mapInArrow

    schema = T.StructType([T.StructField("id", T.LongType())])
    for step in (rows_transform(lambda rows: rows, schema), pandas_transform(len, schema)):
        subprocess.run(
            [sys.executable, "-c", "import pickle, sys; pickle.load(sys.stdin.buffer)"],
            input=step(Frame()), cwd=tmp_path, check=True, timeout=60,
        )


def test_rows_transform_keeps_types(spark):
    df = spark.sql(
        "SELECT DATE'2024-01-02' d, TIMESTAMP_NTZ'2024-01-02 03:04:05.000006' n, "
        "TIMESTAMP'2024-01-02 03:04:05Z' z, 1.50BD x, 'u' s, CAST(NULL AS INT) i"
    )
    assert apply_steps(df, [rows_transform(lambda rows: rows, df.schema)]).collect() == df.collect()


def test_pandas_transform(spark):
    step = pandas_transform(lambda frame: frame[frame["id"] > 1], "id bigint")
    assert [r.id for r in apply_steps(spark.range(4), [step]).orderBy("id").collect()] == [2, 3]


def test_project(spark):
    schema = T.StructType.fromDDL("film_id string, title string, rating decimal(3,1)")
    df = spark.createDataFrame([(1, "a", "x")], "film_id int, title string, description string")
    out = project(df, schema, ("film_id", "title"))
    assert out.collect() == [("1", "a", None)] and out.schema.names == schema.names
    with pytest.raises(ValueError, match="title"):
        project(df.drop("title"), schema, ("film_id", "title"))


def test_casts_round_half_up_and_overflow_raises(spark):
    schema = T.StructType.fromDDL("v decimal(3,1)")
    df = spark.createDataFrame([(6.25,), (-6.25,)], "v double")
    got = [r.v for r in project(df, schema, ("v",)).collect()]
    assert got == [Decimal("6.3"), Decimal("-6.3")]
    with pytest.raises(Exception, match="NUMERIC_VALUE_OUT_OF_RANGE|out of range|overflow"):
        project(spark.createDataFrame([(1000.0,)], "v double"), schema, ("v",)).collect()


def test_document_keeps_all_columns(spark):
    df = spark.createDataFrame(
        [("f1", Decimal("8.5"), "d")], "film_id string, rating decimal(3,1), description string"
    )
    out = document(df, T.StructType.fromDDL("film_id string, rating float"), ["film_id"])
    assert dict(out.dtypes) == {"film_id": "string", "rating": "float", "description": "string"}
    with pytest.raises(ValueError, match="document id"):
        document(df.drop("film_id"), None, ["film_id"])


def test_average_of_ten_overflows(spark):
    df = spark.createDataFrame([("f", 10), ("f", 10), ("g", 7)], "film_id string, rating int")
    with pytest.raises(Exception, match="NUMERIC_VALUE_OUT_OF_RANGE"):
        rating_aggregate(df, "film_id", "rating", "decimal(3,2)").collect()
    wide = rating_aggregate(df, "film_id", "rating", "decimal(4,2)")
    assert sorted(wide.collect()) == [("f", Decimal("10.00"), 2), ("g", Decimal("7.00"), 1)]


def test_rules(spark):
    df = spark.createDataFrame([(0,), (5,), (11,), (None,)], "rating int")
    out = check_rules(df, {"range": "rating BETWEEN 1 AND 10", "set": F.col("rating").isNotNull()})
    assert sorted(out.collect()) == [("range", 2), ("set", 1)]


def test_keys(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (None, 1), (None, 1)], "a int, b int")
    assert check_keys(df, ["a", "b"]).collect() == [(2, 1)]
    assert check_keys(df.where("false"), ["a", "b"]).collect() == [(0, 0)]


def test_latest_rows(spark):
    df = spark.createDataFrame(
        [(1, 5, "old"), (1, 6, "a"), (1, 6, "b"), (2, None, "n"), (2, 0, "z")],
        "k int, at int, v string",
    )
    out = sorted(latest_rows(df, ["k"], ["at"]).collect())
    assert out == [(1, 6, "b", 3), (2, 0, "z", 2)]
    assert latest_rows(df.select("k"), ["k"]).orderBy("k").collect() == [(1, 3), (2, 2)]


def test_latest_rows_with_a_map_column(spark):
    df = spark.sql("SELECT 1 k, 1 at, map('a', 1) m UNION ALL SELECT 1, 2, map('b', 2)")
    assert latest_rows(df, ["k"], ["at"]).select("m").collect() == [({"b": 2},)]


def test_latest_rows_combines_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 3 AS k", "id AS at", "id AS v")
    text = latest_rows(df, ["k"], ["at"])._jdf.queryExecution().executedPlan().toString()
    assert text.index("partial_max(struct") > text.index("Exchange hashpartitioning(k")


def test_upsert_rows_truth_table(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, v string, kept int")
    new = spark.createDataFrame([(2, None, "x"), (3, "c", "y")], "k int, v string, added string")
    out = sorted(upsert_rows(old, new, ["k"]).select("k", "v", "kept", "added").collect())
    assert out == [(1, "a", 1, None), (2, None, 2, "x"), (3, "c", None, "y")]


def test_sorts(spark):
    df = spark.createDataFrame([(1, 3), (2, None), (3, 1), (4, None)], "id int, at int")
    assert [r.id for r in top_rows(df, ["at", "id"], 3).collect()] == [3, 1, 2]
    assert [r.id for r in oldest_row(df, "at", "id").collect()] == [2]
    groups = df.withColumn("g", F.col("id") % 2)
    assert sorted(r.id for r in last_per_group(groups, ["g"], ["id"]).collect()) == [3, 4]


def test_counts(spark):
    out = table_counts({"a": spark.range(3), "b": spark.range(0)})
    assert sorted(out.collect()) == [("a", 3), ("b", 0)]
    with pytest.raises(ValueError):
        table_counts({})


def test_reconcile(spark):
    source = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (5, "e")], "k int, v string")
    target = spark.createDataFrame([(1, "a"), (2, "B"), (3, None), (4, "d")], "k int, v string")
    assert sorted(summary(source, target, "k").collect()) == [
        ("source", 4, 1, 5), ("target", 4, 1, 4)
    ]
    found = key_differences(source, target, ["k"], ["v"])
    assert sorted(found.collect()) == [(2, "changed"), (4, "extra"), (5, "missing")]
    keys_only = key_differences(source, target, ["k"])
    assert sorted(keys_only.collect()) == [(4, "extra"), (5, "missing")]
    hot = source.unionByName(spark.range(5000).selectExpr("1 AS k", "'a' AS v"))
    assert sorted(key_differences(hot, target, ["k"], ["v"]).collect()) == sorted(found.collect())


@pytest.mark.parametrize("parts", [1, 7, 4096])
def test_differences_by_digest_equal_brute_force(spark, parts):
    rng = random.Random(parts)
    make = lambda: [(rng.choice([*range(60), None]), rng.choice(["a", "b", None])) for _ in range(80)]
    left, right = make(), make()
    right += left[:20]
    side = lambda rows, kind: spark.createDataFrame(rows, f"k {kind}, v string")
    found = key_differences(side(left, "int"), side(right, "bigint"), ["k"], ["v"], parts)
    order = lambda v: (v is not None, v or "")
    want = set()
    for k in {k for k, _ in left + right}:
        a, b = (sorted((v for x, v in rows if x == k), key=order) for rows in (left, right))
        if not a or not b:
            want.add((k, "extra" if not a else "missing"))
        elif (a[0], a[-1]) != (b[0], b[-1]):
            want.add((k, "changed"))
    assert {tuple(r) for r in found.collect()} == want


def test_equal_sides_shuffle_only_digests(spark):
    rows = spark.range(50_000).selectExpr("id AS k", "repeat('x', 50) AS v", "id AS _side", "id AS _part")
    found = key_differences(rows, rows.repartition(3), ["k"], ["v", "_side", "_part"], parts=64)
    assert found.count() == 0
    one = rows.withColumn("v", F.when(F.col("k") == 77, "y").otherwise(F.col("v")))
    assert [tuple(r) for r in key_differences(rows, one, ["k"], ["v"], parts=64).collect()] == [(77, "changed")]


def test_rows_transform_passes_the_pipeline_to_functions_that_take_it(spark):
    df = spark.createDataFrame([(1,)], "id bigint")

    def named(rows, pipeline):
        return [{"id": r["id"] + pipeline["step"]} for r in rows]

    def free(rows, **about):
        return [{"id": about["pipeline"]["step"]} for _ in rows]

    for fn, want in ((named, 42), (free, 41), (lambda rows: rows, 1), (list, 1)):
        assert apply_steps(df, [rows_transform(fn, "id bigint", pipeline={"step": 41})]).first()[0] == want
