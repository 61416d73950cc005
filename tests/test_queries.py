"""Every registered query against its SQL in DuckDB."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as driver
import suite
from suite.reads import TABLES

QUERIES = driver.queries()
ORACLES = driver.oracle_sql()


@pytest.fixture(scope="module")
def duck(small):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    return connection


def sorted_rows(rows):
    return sorted(repr(tuple(row)) for row in rows)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_only_corpus_queries_lack_sql():
    assert set(suite.QUERIES) <= set(ORACLES)


# Queries that SQL cannot express have tests of their own.
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, small, name):
    df = QUERIES[name](spark, small)
    columns = sorted(df.columns)
    got = df.select(*columns).collect()
    result = duck.execute(ORACLES[name])
    names = [entry[0] for entry in result.description]
    assert sorted(names) == columns
    order = [names.index(column) for column in columns]
    wanted = [[row[i] for i in order] for row in result.fetchall()]
    assert sorted_rows(got) == sorted_rows(wanted)


def test_entry(spark):
    assert driver.entry(spark).count() > 0
