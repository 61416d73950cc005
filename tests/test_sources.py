from __future__ import annotations

import pytest

from marts.sources import ordered_page, register_table, spark_cast_names, sql_source


def test_empty_query_is_an_error(spark):
    for text in ("", "  ", " ; ", None):
        with pytest.raises(ValueError, match="empty"):
            sql_source(spark, text)


def test_trailing_semicolon_and_comment(spark):
    assert sql_source(spark, "SELECT 1 AS a; ").collect() == [(1,)]
    assert sql_source(spark, "SELECT 1 AS a -- the end").collect() == [(1,)]


def test_parameters(spark):
    df = sql_source(spark, "SELECT id FROM range(10) WHERE id > :low LIMIT :n", {"low": 3, "n": 2})
    assert df.count() == 2


def test_cast_names_leave_quoted_text_alone():
    text = "SELECT a::float8, b :: TEXT, '::float8 it''s' AS \"x::int8\" -- ::text\nFROM t"
    assert spark_cast_names(text) == (
        "SELECT a::double, b ::string, '::float8 it''s' AS \"x::int8\" -- ::text\nFROM t"
    )
    assert spark_cast_names("a::textual") == "a::textual"


def test_schema_qualified_source(spark, root):
    spark.createDataFrame(
        [("f1", 7), ("f1", 8), ("f2", 10)], "film_id string, rating int"
    ).write.parquet(f"{root}/ratings")
    register_table(spark, "ugc_source.ratings", f"{root}/ratings")
    rows = sql_source(
        spark,
        "SELECT r.film_id AS film_id, AVG(r.rating)::float8 AS avg_rating, "
        "COUNT(*)::int AS rating_count FROM ugc_source.ratings r GROUP BY r.film_id",
    )
    assert sorted(rows.collect()) == [("f1", 7.5, 2), ("f2", 10.0, 1)]


def test_lateral_select_is_a_projection(spark):
    """CROSS JOIN LATERAL of a SELECT without FROM runs without any join."""
    df = sql_source(
        spark, "SELECT * FROM range(3) q CROSS JOIN LATERAL (SELECT q.id * 2 AS twice) s"
    )
    assert sorted(df.collect()) == [(0, 0), (1, 2), (2, 4)]
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()


def test_ordered_page_puts_nulls_last(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 4)], "id int, v int")
    assert [r.id for r in ordered_page(df, ["v", "id"], 1, 5).collect()] == [2, 1]
    pages = [r.id for k in range(0, 4, 2) for r in ordered_page(df, ["v", "id"], k, 2).collect()]
    assert pages == [3, 2, 1]


def test_type_names_inside_casts_only():
    text = "SELECT CAST((a + 1) AS float8), x::NUMERIC, y::numeric(4,1) FROM (SELECT 'CAST(' AS text) t"
    assert spark_cast_names(text) == (
        "SELECT CAST((a + 1) AS double), x::decimal(38,18), y::numeric(4,1) FROM (SELECT 'CAST(' AS text) t"
    )


def test_bare_numeric_keeps_its_fraction(spark):
    assert float(sql_source(spark, "SELECT 3.75::NUMERIC AS n").first().n) == 3.75
