from __future__ import annotations

import os
import threading
from datetime import datetime, timedelta, timezone
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marts.plans import ConcurrentChange, MartTable, TargetSpec, merge_into
from marts.plans.films import FILM_DIM, FILM_DIM_DOCUMENTS
from marts.plans.storage import Folder

NOW = datetime(2024, 6, 1, 12, tzinfo=timezone.utc)
LATER = NOW + timedelta(days=1)
FILMS = "film_id string, title string, rating double"
PLAIN = TargetSpec("plain", ("k",), "k INT NOT NULL, v INT", buckets=8)


def films(spark, *values, schema=FILMS):
    return spark.createDataFrame(list(values), schema)


def content(table, *columns):
    df = table.read()
    return sorted(tuple(r) for r in df.select(*(columns or df.columns)).collect())


def test_replace(spark, root):
    table = MartTable(spark, root, FILM_DIM)
    first = table.upsert(films(spark, ("a", "A", 8.5), ("b", "B", 7.0)), now=NOW)
    assert (first.version, first.rows_written) == (1, 2)
    # No rating column: replace writes NULL. Extra columns are dropped.
    second = spark.createDataFrame([("b", "B2", "text")], "film_id string, title string, description string")
    table.upsert(second, now=LATER)
    assert content(table, "film_id", "title", "rating") == [
        ("a", "A", Decimal("8.5")), ("b", "B2", None)
    ]
    loaded = table.read().select("film_id", F.unix_seconds("updated_at").alias("at")).collect()
    assert {r.film_id: r["at"] for r in loaded} == {"a": NOW.timestamp(), "b": LATER.timestamp()}
    assert content_of(table.read(1)) == [("a", "A"), ("b", "B")]


def content_of(df):
    return sorted((r.film_id, r.title) for r in df.collect())


def test_load_time_is_never_the_sources(spark, root):
    table = MartTable(spark, root, FILM_DIM)
    df = films(spark, ("a", "A", 1.0)).withColumn("updated_at", F.lit("2001-01-01").cast("timestamp"))
    table.upsert(df, now=NOW)
    assert table.read().select(F.unix_seconds("updated_at")).first()[0] == NOW.timestamp()


def test_merge_keeps_absent_columns_and_takes_nulls(spark, root):
    table = MartTable(spark, root, FILM_DIM_DOCUMENTS)
    table.upsert(films(spark, ("a", "A", 8.5), ("b", "B", 7.0)))
    schema = "film_id string, title string, description string"
    table.upsert(spark.createDataFrame([("a", "A2", "new")], schema))
    table.upsert(films(spark, ("b", "B", None), ("c", "C", 1.0)))
    assert content(table, "film_id", "title", "rating", "description") == [
        ("a", "A2", 8.5, "new"), ("b", "B", None, None), ("c", "C", 1.0, None)
    ]
    assert dict(table.read().dtypes)["rating"] == "float"


def test_dynamic_documents_keep_the_first_type(spark, root):
    table = MartTable(spark, root, TargetSpec("docs", ("id",), mode="merge"))
    table.upsert(spark.createDataFrame([(1, 5)], "id bigint, n bigint"))
    table.upsert(spark.createDataFrame([(1, 7, True)], "id int, n int, flag boolean"))
    assert content(table) == [(1, 7, True)]
    assert dict(table.read().dtypes) == {"id": "bigint", "n": "bigint", "flag": "boolean"}
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        table.upsert(spark.createDataFrame([(2, "x")], "id bigint, n string"))


def test_dynamic_fields_grow_with_their_values(spark, root):
    table = MartTable(spark, root, TargetSpec("docs", ("id",), mode="merge", buckets=4))
    for i in range(8):
        table.upsert(spark.createDataFrame([(i, 5, [1])], "id bigint, n int, a array<int>"))
    table.upsert(spark.createDataFrame([(8, 2**40)], "id bigint, n bigint"))
    assert dict(table.read().dtypes)["n"] == "bigint"
    table.upsert(spark.createDataFrame([(2, 7.5, [0.5])], "id bigint, n double, a array<double>"))
    rows = {r["id"]: (r["n"], r["a"]) for r in table.read().collect()}
    assert rows[2] == (7.5, [0.5]) and rows[1] == (5.0, [1.0]) and rows[8] == (2.0**40, None)
    assert dict(table.read().dtypes) == {"id": "bigint", "n": "double", "a": "array<double>"}
    table.upsert(spark.createDataFrame([(3, 9, "new")], "id bigint, n int, s string"))
    assert {r["id"]: r["n"] for r in table.read().collect()}[3] == 9.0
    table.rebucket(8)
    assert {r["id"]: r["n"] for r in table.read().collect()} == {
        **{i: 5.0 for i in (0, 1, 4, 5, 6, 7)}, 2: 7.5, 3: 9.0, 8: 2.0**40
    }
    assert table.manifest().types == {}


def test_fields_that_do_not_fit_fail_with_their_name(spark, root):
    table = MartTable(spark, root, TargetSpec("docs", ("id",), mode="merge"))
    table.upsert(spark.createDataFrame([(1, 2**53 + 1, True)], "id bigint, n bigint, flag boolean"))
    with pytest.raises(ValueError, match="1 values of field 'n' would lose digits"):
        table.upsert(spark.createDataFrame([(2, 7.5)], "id bigint, n double"))
    with pytest.raises(ValueError, match="field 'flag' holds boolean and cannot take int"):
        table.upsert(spark.createDataFrame([(2, 1)], "id bigint, flag int"))
    with pytest.raises(ValueError, match="field 'n' holds bigint and cannot take array<bigint>"):
        table.upsert(spark.createDataFrame([(2, [1])], "id bigint, n array<bigint>"))
    table.upsert(spark.createDataFrame([(1, 4)], "id bigint, n bigint"))
    table.upsert(spark.createDataFrame([(2, 7.5)], "id bigint, n double"))
    with pytest.raises(Exception, match="field 'n' is double and cannot hold 9007199254740993"):
        table.upsert(spark.createDataFrame([(3, 2**53 + 1)], "id bigint, n bigint"))
    assert content(table) == [(1, 4.0, True), (2, 7.5, None)]


def test_fields_with_the_names_of_helper_columns(spark, root):
    table = MartTable(spark, root, TargetSpec("docs", ("id",), mode="merge", rules={"r": "id > 0"}))
    names = "id bigint, _sent int, _row string, _broken_0 int, _order_0 int, _new boolean, at int"
    rows = spark.createDataFrame([(1, 1, "a", 2, 3, True, 4), (1, 5, "b", 6, 7, False, 5)], names)
    for _ in range(2):
        table.upsert(rows, order=("at",))
    assert content(table) == [(1, 5, "b", 6, 7, False, 5)]


def test_null_keys_are_an_error_for_both_rules(spark, root):
    for spec in (FILM_DIM, FILM_DIM_DOCUMENTS):
        table = MartTable(spark, root, spec)
        with pytest.raises(ValueError, match="1 rows with a NULL key"):
            table.upsert(films(spark, ("a", "A", 1.0), (None, "N", 1.0)))
        assert table.versions() == []


def test_missing_columns_fail_before_running(spark, root):
    table = MartTable(spark, root, FILM_DIM)
    with pytest.raises(ValueError, match="title"):
        table.upsert(spark.createDataFrame([("a",)], "film_id string"))


def test_rules_stop_the_load(spark, root):
    spec = TargetSpec(
        "ratings", ("id",), "id INT NOT NULL, rating INT NOT NULL",
        rules={"rating 1..10": "rating BETWEEN 1 AND 10"},
    )
    table = MartTable(spark, root, spec)
    bad = spark.createDataFrame([(1, 0), (2, 11), (3, 5), (4, None)], "id int, rating int")
    with pytest.raises(ValueError) as error:
        table.upsert(bad)
    assert "1 rows break rule 'rating is not null'" in str(error.value)
    assert "2 rows break rule 'rating 1..10'" in str(error.value)
    assert table.versions() == [] and Folder(spark, root).entries("ratings/staging") == []
    assert table.upsert(bad.where("id = 3")).rows_written == 1


def test_required_not_null_title(spark, root):
    with pytest.raises(ValueError, match="title is not null"):
        MartTable(spark, root, FILM_DIM).upsert(films(spark, ("a", None, 1.0)))


def test_repeated_keys(spark, root):
    table = MartTable(spark, root, PLAIN)
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 3)], "k int, v int").withColumn(
        "at", F.lit(10) - F.col("v")
    )
    with pytest.raises(ValueError, match="1 keys are repeated"):
        table.upsert(df)
    assert table.upsert(df, order=("at",)).rows_written == 3  # rows sent, not rows kept
    assert content(table) == [(1, 1), (2, 3)]
    with pytest.raises(ValueError, match="order columns"):
        table.upsert(df, order=("nope",))


def test_order_columns_are_shuffled_once(spark, root):
    """A kept order column ranks as it is; a dropped or changed one is carried."""
    spec = TargetSpec("ranked", ("k",), "k INT NOT NULL, v INT, at TIMESTAMP", load_time="at")
    table = MartTable(spark, root, spec)
    df = spark.createDataFrame(
        [(1, 1, 10, "b"), (1, 2, 9, "z"), (1, 2, 9, "c")], "k int, v int, other int, at string"
    )
    rows, ranking = table._conform(df, ("v", "other", "at", "k"), NOW, table.manifest())
    assert ranking == ["v", "_order_1", "_order_2", "k"]
    assert rows.columns == ["k", "v", "at", "_order_1", "_order_2"]
    table.upsert(df, order=("other", "v"), now=NOW)
    assert content(table, "k", "v") == [(1, 1)]
    documents = MartTable(spark, root, TargetSpec("doc", ("k",), mode="merge"))
    changed = df.withColumn("d", F.lit("9.5").cast("decimal(3,1)"))
    rows, ranking = documents._conform(changed, ("d", "v"), None, documents.manifest())
    assert ranking == ["_order_0", "v"]


def test_idempotent_except_load_time(spark, root):
    table = MartTable(spark, root, FILM_DIM)
    df = films(spark, ("a", "A", 8.5), ("b", "B", None))
    table.upsert(df, now=NOW)
    before = content(table, "film_id", "title", "rating")
    table.upsert(df, now=LATER)
    assert content(table, "film_id", "title", "rating") == before


def test_only_touched_buckets_are_rewritten(spark, root):
    table = MartTable(spark, root, PLAIN)
    table.upsert(spark.range(200).selectExpr("CAST(id AS INT) AS k", "1 AS v"))
    before = table.manifest()
    assert len(before.files) == 8
    result = table.upsert(spark.createDataFrame([(17, 2)], "k int, v int"))
    after = table.manifest()
    assert result.buckets_touched == 1
    assert sum(before.files[b] != after.files[b] for b in range(8)) == 1
    assert table.read().agg(F.count("*"), F.sum("v")).collect() == [(200, 201)]


def test_one_file_per_bucket_whatever_the_shuffle_width(spark, root):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    for width in ("8", "4", "7", "32"):
        spark.conf.set("spark.sql.shuffle.partitions", width)
        try:
            table = MartTable(spark, f"{root}/w{width}", PLAIN)
            rows = spark.range(500).selectExpr("CAST(id AS INT) AS k", "1 AS v")
            table.upsert(rows)
            assert len(table.read().inputFiles()) == 8
            table.upsert(rows.selectExpr("k + 250 AS k", "2 AS v"))
            assert len(table.read().inputFiles()) == 8
            assert table.read().agg(F.count("*"), F.sum("v")).collect() == [(750, 1250)]
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", old)


def test_merge_shuffles_each_side_once(spark, root, monkeypatch):
    """Join and bucket write share one partitioning."""
    plans = []
    original = MartTable._write_buckets

    def spy(self, df, buckets, path):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        original(self, df, buckets, path)

    monkeypatch.setattr(MartTable, "_write_buckets", spy)
    table = MartTable(spark, root, PLAIN)
    table.upsert(spark.range(100).selectExpr("CAST(id AS INT) AS k", "1 AS v"))
    table.upsert(spark.range(100).selectExpr("CAST(id AS INT) AS k", "2 AS v"))
    table.upsert(spark.createDataFrame([(5, 3)], "k int, v int"))
    table.upsert(spark.range(100).selectExpr("CAST(id AS INT) AS k", "4 AS v"))
    # First load: the grouping's shuffle (8 wide) already places the buckets.
    assert plans[0].count("Exchange hashpartitioning") == 1
    # All in one snapshot: only the incoming rows are shuffled.
    assert plans[1].count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plans[1]
    # One bucket of eight, then two snapshots: the rows read are shuffled too.
    assert plans[2].count("Exchange hashpartitioning") == 2
    assert plans[3].count("Exchange hashpartitioning") == 2
    assert all("FullOuter" in plan for plan in plans[1:])
    assert content(table) == [(k, 4) for k in range(100)]


def test_reading_by_key_needs_no_shuffle(spark, root):
    table = MartTable(spark, root, PLAIN)
    table.upsert(spark.range(100).selectExpr("CAST(id AS INT) AS k", "1 AS v"))
    plan = table.read().groupBy("k").agg(F.sum("v"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan
    assert [t.name for t in spark.catalog.listTables() if t.name.startswith("marts_")] == []


def test_many_snapshots_are_joined_into_one(spark, root, monkeypatch):
    from marts.plans import target as target_module

    monkeypatch.setattr(target_module, "_MAX_SNAPSHOTS", 3)
    table = MartTable(spark, root, PLAIN)
    table.upsert(spark.range(64).selectExpr("CAST(id AS INT) AS k", "0 AS v"))
    counts = []
    for k in (0, 1, 2, 3, 4):
        table.upsert(spark.createDataFrame([(k, k + 1)], "k int, v int"))
        counts.append(len(table.manifest().snapshots()))
    assert max(counts) <= 3 and 1 in counts
    assert content(table) == [(k, k + 1 if k < 5 else 0) for k in range(64)]


def test_failure_before_publish_leaves_the_old_version(spark, root, monkeypatch):
    table = MartTable(spark, root, PLAIN)
    table.upsert(spark.createDataFrame([(1, 1)], "k int, v int"))

    def crash(name, text):
        raise OSError("lost")

    monkeypatch.setattr(table.folder, "publish", crash)
    with pytest.raises(OSError):
        table.upsert(spark.createDataFrame([(1, 2)], "k int, v int"))
    monkeypatch.undo()
    assert content(table) == [(1, 1)] and table.versions() == [1]
    table.upsert(spark.createDataFrame([(1, 2)], "k int, v int"))
    assert content(table) == [(1, 2)]


def test_two_writers_on_one_version(spark, root):
    table = MartTable(spark, root, PLAIN)
    table.upsert(spark.range(64).selectExpr("CAST(id AS INT) AS k", "0 AS v"))
    one = table.stage(spark.createDataFrame([(1, 1), (2, 1)], "k int, v int"))
    two = table.stage(spark.createDataFrame([(2, 2), (3, 2)], "k int, v int"))
    table.publish(one)
    table.publish(two)
    assert [r for r in content(table) if r[1]] == [(1, 1), (2, 2), (3, 2)]


def test_first_loads_that_race(spark, root):
    table = MartTable(spark, root, PLAIN)
    one = table.stage(spark.createDataFrame([(1, 1), (2, 1)], "k int, v int"))
    two = table.stage(spark.createDataFrame([(2, 2), (3, 2)], "k int, v int"))
    table.publish(one)
    table.publish(two)
    assert content(table) == [(1, 1), (2, 2), (3, 2)]


def test_taken_manifest_is_retried(spark, root, monkeypatch):
    """A writer that loses the race merges again on the new version."""
    table = MartTable(spark, root, PLAIN)
    table.upsert(spark.range(64).selectExpr("CAST(id AS INT) AS k", "0 AS v"))
    other = MartTable(spark, root, PLAIN)
    publish = table.folder.publish
    calls = []

    def late(name, text):
        if not calls:
            calls.append(name)
            other.upsert(spark.createDataFrame([(1, 5), (7, 5)], "k int, v int"))
        publish(name, text)

    monkeypatch.setattr(table.folder, "publish", late)
    result = table.upsert(spark.createDataFrame([(1, 9)], "k int, v int"))
    assert result.version == 3
    assert [r for r in content(table) if r[1]] == [(1, 9), (7, 5)]


def test_concurrent_threads(spark, root):
    table = MartTable(spark, root, PLAIN)
    table.upsert(spark.range(40).selectExpr("CAST(id AS INT) AS k", "0 AS v"))
    errors = []

    def write(n):
        try:
            MartTable(spark, root, PLAIN).upsert(
                spark.range(5).selectExpr(f"CAST(id * 8 + {n} AS INT) AS k", f"{n + 1} AS v")
            )
        except Exception as error:  # noqa: BLE001
            errors.append(error)

    threads = [threading.Thread(target=write, args=(n,)) for n in range(4)]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join()
    assert errors == []
    assert content(table) == sorted((k, k % 8 + 1 if k % 8 < 4 else 0) for k in range(40))


def test_job_advanced_elsewhere(spark, root):
    from marts.operators import Cursor

    table = MartTable(spark, root, PLAIN)
    here = Cursor("2024-01-01T00:00:00.000000", "1", "timestamp_ntz", "int")
    there = Cursor("2024-01-02T00:00:00.000000", "1", "timestamp_ntz", "int")
    staged = table.stage(spark.createDataFrame([(1, 1)], "k int, v int"))
    table.publish(staged, "job", None, here)
    again = table.stage(spark.createDataFrame([(1, 2)], "k int, v int"))
    with pytest.raises(ConcurrentChange):
        table.publish(again, "job", None, there)
    assert table.cursor("job") == here and content(table) == [(1, 1)]


def test_reset_and_vacuum(spark, root):
    table = MartTable(spark, root, PLAIN)
    for v in range(4):
        table.upsert(spark.createDataFrame([(1, v)], "k int, v int"))
    dropped = table.vacuum(keep=2)
    assert table.versions() == [3, 4] and len(dropped) == 4
    assert content(table) == [(1, 3)] and table.read(3).collect() == [(1, 2)]
    # Unlisted snapshots are kept while they may belong to a running writer.
    staged = table.stage(spark.createDataFrame([(1, 9)], "k int, v int"))
    table.vacuum(keep=1)
    table.publish(staged)
    assert content(table) == [(1, 9)]
    table.reset()
    assert table.read().count() == 0 and table.manifest().cursors == {}
    table.upsert(spark.createDataFrame([(5, 5)], "k int, v int"))
    assert content(table) == [(5, 5)]


def test_vacuum_removes_old_orphans(spark, root):
    table = MartTable(spark, root, PLAIN)
    table.upsert(spark.createDataFrame([(1, 1)], "k int, v int"))
    orphan = table.stage(spark.createDataFrame([(1, 2)], "k int, v int"))
    assert os.path.isdir(table.folder.at(orphan.folder))
    table.vacuum(orphan_age=timedelta(seconds=-60))
    assert not os.path.isdir(table.folder.at(orphan.folder))
    assert content(table) == [(1, 1)]


def test_rebucket(spark, root):
    table = MartTable(spark, root, PLAIN)
    table.upsert(spark.range(300).selectExpr("CAST(id AS INT) AS k", "1 AS v"))
    before = content(table)
    pending = table.stage(spark.createDataFrame([(3, 7)], "k int, v int"))
    table.rebucket(32)
    assert content(table) == before and table.manifest().buckets == 32
    table.publish(pending)  # staged for 8 buckets
    table.rebucket(2)
    expected = sorted((k, 7 if k == 3 else v) for k, v in before)
    assert content(table) == expected


def test_bucket_count_follows_size(spark, root):
    table = MartTable(spark, root, TargetSpec("auto", ("k",), "k INT, v INT"))
    assert table._bucket_count(10) == 1
    assert table._bucket_count(100 << 20) == 8
    assert table._bucket_count(1 << 40) == 8192
    # Spark's own limit on bucket numbers.
    assert table._bucket_count(100 << 40) == 65536
    with pytest.raises(ValueError):
        TargetSpec("x", ("k",), "k INT", buckets=6)


def test_composite_and_string_keys(spark, root):
    spec = TargetSpec("pairs", ("a", "b"), "a STRING NOT NULL, b INT NOT NULL, v DOUBLE", buckets=4)
    table = MartTable(spark, root, spec)
    table.upsert(spark.createDataFrame([("x", 1, 1.0), ("x", 2, 2.0)], "a string, b int, v double"))
    table.upsert(spark.createDataFrame([("x", 2, 5.0), ("y", 1, 3.0)], "a string, b int, v double"))
    assert content(table) == [("x", 1, 1.0), ("x", 2, 5.0), ("y", 1, 3.0)]


@pytest.mark.parametrize(
    "dtype", ["BIGINT", "STRING", "DECIMAL(20,2)", "DATE", "TIMESTAMP_NTZ", "DOUBLE", "BOOLEAN"]
)
def test_bucket_numbers_agree_for_every_key_type(spark, root, dtype):
    """The touched buckets are computed, the files' buckets are named by Spark."""
    casts = {
        "DATE": "date_add(DATE'2024-01-01', CAST(id AS INT))",
        "TIMESTAMP_NTZ": "TIMESTAMP_NTZ'2024-01-01' + make_dt_interval(0, CAST(id AS INT))",
        "BOOLEAN": "id % 2 = 0",
    }
    rows = spark.range(40).selectExpr(f"{casts.get(dtype, f'CAST(id AS {dtype})')} AS k", "id AS v")
    spec = TargetSpec("typed", ("k",), f"k {dtype} NOT NULL, v BIGINT", buckets=4)
    table = MartTable(spark, root, spec)
    table.upsert(rows.where("v < 30"), order=("v",))
    table.upsert(rows.where("v >= 30"), order=("v",))
    table.upsert(rows.where("v = 7").withColumn("v", F.lit(1000)), order=("v",))
    found = table.read().agg(F.count("*"), F.max("v")).first()
    assert tuple(found) == (2 if dtype == "BOOLEAN" else 40, 1000)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(
        st.lists(st.tuples(st.integers(0, 12), st.integers(0, 99)), min_size=1, max_size=15),
        min_size=1, max_size=3,
    )
)
def test_upserts_equal_a_dict(spark, tmp_path_factory, batches):
    table = MartTable(spark, str(tmp_path_factory.mktemp("model")), PLAIN)
    model = {}
    for batch in batches:
        rows = [(k, v, i) for i, (k, v) in enumerate(batch)]
        table.upsert(spark.createDataFrame(rows, "k int, v int, at int"), order=("at",))
        model.update({k: v for k, v, _ in rows})
    assert content(table) == sorted(model.items())


def test_ansi_is_required(spark, root):
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        with pytest.raises(ValueError, match="ansi"):
            MartTable(spark, root, PLAIN).upsert(spark.createDataFrame([(1, 1)], "k int, v int"))
    finally:
        spark.conf.set("spark.sql.ansi.enabled", "true")


def test_publish_is_exclusive(spark, root):
    folder = Folder(spark, root)
    folder.publish("m/one", "a")
    with pytest.raises(FileExistsError):
        folder.publish("m/one", "b")
    assert folder.read("m/one") == "a"
    assert [name for name, _ in folder.entries("m")] == ["one"]


def test_publish_by_rename(spark, root, monkeypatch):
    """The way taken on file systems other than the local one."""
    folder = Folder(spark, root)
    monkeypatch.setattr(folder, "_link", folder._rename)
    folder.publish("m/one", "a")
    with pytest.raises(FileExistsError):
        folder.publish("m/one", "b")
    assert folder.read("m/one") == "a"


def test_merge_into_builds_sparks_merge(spark, root):
    """Built-in Parquet tables refuse MERGE; the statement gets as far as that."""
    spark.range(1).selectExpr("CAST(id AS INT) AS k", "1 AS v").write.parquet(f"{root}/t")
    spark.catalog.createTable("merge_target", path=f"{root}/t", source="parquet")
    df = spark.createDataFrame([(1, 1), (1, 2)], "k int, v int")
    with pytest.raises(Exception, match="MERGE INTO TABLE"):
        merge_into(df, "merge_target", ["k"], ["v"])


def test_columns_that_differ_by_case(spark, root):
    table = MartTable(spark, root, FILM_DIM)
    table.upsert(spark.sql("SELECT 'a' AS FILM_ID, 'A' AS Title, 5.0 AS RATING"))
    assert content(table, "film_id", "title", "rating") == [("a", "A", Decimal("5.0"))]
    with pytest.raises(ValueError, match="only by case"):
        table.upsert(spark.sql("SELECT 'a' AS film_id, 'A' AS title, 1 AS rating").toDF("film_id", "title", "Title"))


def test_a_late_older_row_does_not_win(spark, root):
    table = MartTable(spark, root, TargetSpec("last", ("id",), "id BIGINT, ts INT, v STRING"))
    table.upsert(spark.createDataFrame([(1, 2, "new")], "id long, ts int, v string"), order=("ts",))
    late = [(1, 1, "old"), (2, 1, "first")]
    table.upsert(spark.createDataFrame(late, "id long, ts int, v string"), order=("ts",))
    assert content(table, "id", "ts", "v") == [(1, 2, "new"), (2, 1, "first")]


def test_bucket_count_follows_the_target(spark, root, monkeypatch):
    monkeypatch.setattr("marts.plans.target.BUCKET_BYTES", 1 << 16)
    table = MartTable(spark, root, TargetSpec("grown", ("id",), "id BIGINT, v DOUBLE"))
    rows = lambda n: spark.range(n).select("id", F.rand(1).alias("v"))
    table.upsert(rows(10))
    assert table.manifest().buckets == 1
    table.upsert(rows(100_000))
    assert table.manifest().buckets > 1 and table.read().count() == 100_000
    assert not os.path.exists(f"{root}/grown/staging") or not os.listdir(f"{root}/grown/staging")
