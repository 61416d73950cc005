from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marts.operators import (
    Cursor,
    CursorColumns,
    backlog,
    check_cursor_columns,
    first_rows,
    later,
    plan_slices,
    slice_bounds,
)
from marts.operators import slices as slices_module

COLUMNS = CursorColumns("at", "id")
T0 = datetime(2024, 1, 1)


def rows(spark, values, id_type="bigint"):
    return spark.createDataFrame(values, f"at timestamp_ntz, id {id_type}")


def cursor(moment, id_, id_type="bigint"):
    return Cursor(moment.isoformat(timespec="microseconds"), str(id_), "timestamp_ntz", id_type)


def test_cursor_needs_key_and_id():
    with pytest.raises(ValueError, match="both"):
        Cursor("2024-01-01T00:00:00.000000", None, "timestamp_ntz", "bigint")


def test_column_names_are_identifiers():
    for name in ("", "a b", "x;drop", "1a", None):
        with pytest.raises(ValueError):
            CursorColumns(name, "id")


def test_columns_are_checked_before_running(spark):
    schema = rows(spark, []).schema
    check_cursor_columns(schema, COLUMNS)
    with pytest.raises(ValueError, match="does not return"):
        check_cursor_columns(schema, CursorColumns("updated_at", "id"))
    with pytest.raises(ValueError, match="timestamp"):
        check_cursor_columns(schema, CursorColumns("id", "at"))


def test_resume_inside_a_tie_group(spark):
    df = rows(spark, [(T0, i) for i in (9, 10, 100)] + [(T0 + timedelta(days=1), 1)])
    rest = backlog(df, COLUMNS, cursor(T0, 9))
    # Numeric order, not text order.
    assert sorted(r.id for r in rest.collect()) == [1, 10, 100]
    assert [r.id for r in first_rows(rest, COLUMNS, 2).collect()] == [10, 100]


def test_string_and_decimal_ids(spark):
    texts = rows(spark, [(T0, "a"), (T0, "b"), (T0, "c")], "string")
    assert [r.id for r in backlog(texts, COLUMNS, cursor(T0, "b", "string")).collect()] == ["c"]
    exact = rows(spark, [(T0, Decimal("9.5")), (T0, Decimal("10.5"))], "decimal(5,1)")
    rest = backlog(exact, COLUMNS, cursor(T0, "9.5", "decimal(5,1)"))
    assert [r.id for r in rest.collect()] == [Decimal("10.5")]


def test_filters_reach_the_scan(spark, small):
    orders = spark.read.parquet(f"{small}/orders.parquet")
    columns = CursorColumns("o_orderdate", "o_orderkey")
    start = Cursor("1998-06-15T00:00:00.000000", "700", "timestamp_ntz", "bigint")
    plan = backlog(orders, columns, start).select("o_orderkey")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate,1998-06-15T00:00)" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in text
    overlap = backlog(orders, columns, start, timedelta(days=2))
    text = overlap._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_orderdate,1998-06-13T00:00)" in text


def test_filter_on_grouping_key_goes_below_the_aggregate(spark, small):
    spark.read.parquet(f"{small}/orders.parquet").createOrReplaceTempView("cursor_orders")
    days = spark.sql(
        "SELECT o_orderdate, max(o_orderkey) AS id FROM cursor_orders GROUP BY o_orderdate"
    )
    start = Cursor("1998-06-15T00:00:00.000000", "700", "timestamp_ntz", "bigint")
    rest = backlog(days, CursorColumns("o_orderdate", "id"), start)
    text = rest._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in text


def test_bounds(spark):
    df = rows(spark, [(T0, 3), (T0, 20), (T0 + timedelta(microseconds=1), 1), (None, 5), (T0, None)])
    bounds = slice_bounds(df, COLUMNS)
    assert (bounds.rows, bounds.null_rows) == (5, 2)
    assert bounds.first == cursor(T0, 3)
    assert bounds.last == cursor(T0 + timedelta(microseconds=1), 1)
    with pytest.raises(ValueError, match="2 rows have a NULL"):
        bounds.reject_null_rows(COLUMNS)
    empty = slice_bounds(rows(spark, []), COLUMNS)
    assert empty.rows == 0 and empty.last is None


def test_zoned_key_round_trip(spark):
    moment = datetime(2024, 10, 27, 0, 30, 0, 7, tzinfo=timezone.utc)
    df = spark.createDataFrame(
        [(moment, 1), (moment + timedelta(hours=1), 2)], "at timestamp, id int"
    )
    first = slice_bounds(df, COLUMNS).first
    assert first.key == "2024-10-27T00:30:00.000007+00:00"
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        assert [r.id for r in backlog(df, COLUMNS, first).collect()] == [2]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_null_rows(spark):
    df = rows(spark, [(T0, 1), (None, 2), (T0 + timedelta(1), None), (T0 + timedelta(1), 3)])
    assert backlog(df, COLUMNS, None).count() == 2
    kept = backlog(df, COLUMNS, cursor(T0, 1), keep_null_rows=True)
    assert slice_bounds(kept, COLUMNS).null_rows == 2


def test_overlap_finds_backdated_rows(spark):
    df = rows(spark, [(T0 - timedelta(hours=1), 1), (T0 - timedelta(hours=5), 2), (T0, 3)])
    here = cursor(T0, 3)
    assert backlog(df, COLUMNS, here).count() == 0
    again = backlog(df, COLUMNS, here, overlap=timedelta(hours=2))
    assert sorted(r.id for r in again.collect()) == [1, 3]


def test_later_never_moves_back():
    a, b = cursor(T0, 9), cursor(T0, 10)
    assert later(a, b) == b and later(b, a) == b
    assert later(None, a) == a and later(a, None) == a


def test_all_timestamps_equal(spark):
    df = rows(spark, [(T0, i) for i in range(10)])
    plan = list(plan_slices(df, COLUMNS, 2))
    assert [s.rows for s in plan] == [2] * 5
    assert [sorted(r.id for r in s.of(df, COLUMNS).collect()) for s in plan] == [
        [0, 1], [2, 3], [4, 5], [6, 7], [8, 9]
    ]


def check_partition(df, plan, max_rows):
    """Every row is in exactly one slice, slices are ordered and bounded."""
    total = sorted((r["at"], r["id"]) for r in df.collect())
    seen = []
    for piece in plan:
        part = sorted((r["at"], r["id"]) for r in piece.of(df, COLUMNS).collect())
        assert part and (len(part) <= max_rows or len(set(part)) == 1)
        assert not seen or seen[-1] < part[0]
        seen += part
    assert seen == total


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(st.tuples(st.integers(0, 3), st.integers(-5, 40)), max_size=60),
    st.integers(1, 12),
)
def test_slices_partition_the_rows(spark, values, max_rows):
    df = rows(spark, [(T0 + timedelta(days=d), i) for d, i in values])
    check_partition(df, list(plan_slices(df, COLUMNS, max_rows)), max_rows)


def test_slices_with_a_hot_timestamp(spark, monkeypatch):
    """Ranges of ranges: a third of the rows share one timestamp and one pair is
    repeated beyond the limit."""
    monkeypatch.setattr(slices_module, "FAN_OUT", 4)
    rng = random.Random(5)
    values = [(T0, i) for i in range(1000)]
    values += [(T0 + timedelta(seconds=rng.randrange(5000)), i) for i in range(1600)]
    values += [(T0 + timedelta(seconds=77), 5)] * 400
    df = rows(spark, values).cache()
    plan = list(plan_slices(df, COLUMNS, 200))
    check_partition(df, plan, 200)
    assert sum(s.rows for s in plan) == 3000
    # The hot timestamp itself was cut by id.
    assert sum(s.hi.key == T0.isoformat(timespec="microseconds") for s in plan) >= 4
    df.unpersist()


@pytest.mark.parametrize("points", [16, 1])
@pytest.mark.parametrize("max_rows", [300_001, 40_000, 999])
def test_no_slice_is_above_the_limit(spark, monkeypatch, points, max_rows):
    """300 000 rows: a hot timestamp, runs of repeated pairs and one pair above every limit but
    the first; with one point per slice the cuts need several levels."""
    monkeypatch.setattr(slices_module, "POINTS", points)
    n = 300_000
    seconds = F.when(F.col("id") < n // 3, 50).otherwise(F.pmod(F.xxhash64("id"), F.lit(100_000)))
    number = F.when(F.col("id") >= n - 45_000, 7).otherwise(F.col("id"))
    df = spark.range(n).select(
        F.timestamp_seconds(F.when(F.col("id") >= n - 45_000, 90).otherwise(seconds)).cast("timestamp_ntz").alias("at"),
        number.alias("id"),
    ).cache()
    plan = list(plan_slices(df, COLUMNS, max_rows))
    seen, last = 0, None
    for piece in plan if len(plan) < 40 else random.Random(1).sample(plan, 12):
        counted = piece.of(df, COLUMNS).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("at", "id").alias("pairs")).first()
        assert counted["n"] == piece.rows
        assert piece.rows <= max_rows or counted["pairs"] == 1
    for piece in plan:
        assert piece.rows <= max_rows or piece.rows == 45_000
        assert piece.lo == last
        seen, last = seen + piece.rows, piece.hi
    assert seen == n
    if points == 16:
        assert len(plan) <= 1.25 * n / max_rows + 3
    df.unpersist()
