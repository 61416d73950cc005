"""Sources, cursor reads, joins, aggregates, sorts."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marts.operators import (
    Cursor,
    CursorColumns,
    backlog,
    first_rows,
    last_per_group,
    latest_rows,
    oldest_row,
    rating_aggregate,
    table_counts,
    top_rows,
)
from marts.operators.cursor import bounds_aggregates
from marts.sources import ordered_page, read_table, register_folder, sql_source

from .registry import query

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()
BY_DATE = CursorColumns("o_orderdate", "o_orderkey")
# Inside the orders of one day.
MIDDLE = Cursor("1998-06-15T00:00:00.000000", "7000", "timestamp_ntz", "bigint")
USER_CURSOR = Cursor("2024-01-15T00:00:00.000000", "50", "timestamp_ntz", "bigint")
_PAST_MIDDLE = """(o_orderdate > TIMESTAMP '1998-06-15'
    OR (o_orderdate = TIMESTAMP '1998-06-15' AND o_orderkey > 7000))"""


def _sql(spark: SparkSession, sf_dir: str, text: str, *tables: str) -> DataFrame:
    register_folder(spark, sf_dir, tables)
    return sql_source(spark, text)


@query(
    "full_projection",
    "SELECT p_partkey AS item_id, p_name AS title, p_retailprice AS price FROM part",
)
def full_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "SELECT p_partkey AS item_id, p_name AS title, p_retailprice AS price FROM part;"
    return _sql(spark, sf_dir, text, "part")


@query(
    "source_parameters",
    """SELECT o_orderkey, o_totalprice FROM orders
       WHERE o_orderpriority = '1-URGENT' AND o_totalprice >= 1000""",
)
def source_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_folder(spark, sf_dir, ["orders"])
    return sql_source(
        spark,
        "SELECT o_orderkey, o_totalprice FROM orders "
        "WHERE o_orderpriority = :priority AND o_totalprice >= :least",
        {"priority": "1-URGENT", "least": 1000},
    )


@query(
    "ordered_page",
    """SELECT o_orderkey, o_custkey, o_orderdate FROM orders
       ORDER BY o_orderdate, o_orderkey LIMIT 200 OFFSET 500""",
)
def page(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return ordered_page(orders, ["o_orderdate", "o_orderkey"], offset=500, limit=200)


@query(
    "inc_first_slice",
    """SELECT o_orderkey, o_orderdate, o_totalprice FROM orders
       ORDER BY o_orderdate NULLS LAST, o_orderkey NULLS LAST LIMIT 1000""",
)
def inc_first_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderdate", "o_totalprice"
    )
    return first_rows(backlog(orders, BY_DATE, None), BY_DATE, 1000)


@query("inc_resume", f"SELECT * FROM orders WHERE {_PAST_MIDDLE}")
def inc_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backlog(read_table(spark, sf_dir, "orders"), BY_DATE, MIDDLE)


@query(
    "inc_overlap",
    """SELECT o_orderkey, o_orderdate FROM orders
       WHERE o_orderdate > TIMESTAMP '1998-06-15' - INTERVAL 30 DAY""",
)
def inc_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return backlog(orders, BY_DATE, MIDDLE, overlap=timedelta(days=30))


@query(
    "inc_next_cursor",
    f"""WITH s AS (SELECT o_orderdate, o_orderkey FROM orders WHERE {_PAST_MIDDLE}),
       b AS (SELECT count(*) AS n, min(o_orderdate) AS lo, max(o_orderdate) AS hi FROM s)
       SELECT n AS row_count, lo AS first_key,
         (SELECT min(o_orderkey) FROM s WHERE o_orderdate = (SELECT lo FROM b)) AS first_id,
         hi AS last_key,
         (SELECT max(o_orderkey) FROM s WHERE o_orderdate = (SELECT hi FROM b)) AS last_id
       FROM b""",
)
def inc_next_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = backlog(read_table(spark, sf_dir, "orders"), BY_DATE, MIDDLE)
    return rest.agg(*bounds_aggregates(rest.schema, BY_DATE)).select(
        F.col("rows").alias("row_count"),
        F.col("first.key").alias("first_key"),
        F.col("first.id").alias("first_id"),
        F.col("last.key").alias("last_key"),
        F.col("last.id").alias("last_id"),
    )


@query(
    "inc_over_aggregate",
    """SELECT * FROM (SELECT user_id, max(ts) AS last_ts, count(*) AS n
         FROM events GROUP BY user_id) AS src
       WHERE last_ts > TIMESTAMP '2024-01-15'
          OR (last_ts = TIMESTAMP '2024-01-15' AND user_id > 50)""",
)
def inc_over_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "SELECT user_id, max(ts) AS last_ts, count(*) AS n FROM events GROUP BY user_id"
    users = _sql(spark, sf_dir, text, "events")
    return backlog(users, CursorColumns("last_ts", "user_id"), USER_CURSOR)


@query(
    "inc_grouping_key",
    """SELECT o_orderdate, count(*) AS orders, max(o_orderkey) AS last_order FROM orders
       GROUP BY o_orderdate HAVING o_orderdate > TIMESTAMP '1998-06-15'
          OR (o_orderdate = TIMESTAMP '1998-06-15' AND max(o_orderkey) > 7000)""",
)
def inc_grouping_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cursor key is a grouping key, so its range reaches the scan."""
    text = (
        "SELECT o_orderdate, count(*) AS orders, max(o_orderkey) AS last_order "
        "FROM orders GROUP BY o_orderdate"
    )
    days = _sql(spark, sf_dir, text, "orders")
    return backlog(days, CursorColumns("o_orderdate", "last_order"), MIDDLE)


@query(
    "rating_agg",
    """SELECT l_partkey, CAST(avg(l_quantity) AS DOUBLE) AS avg_rating,
         CAST(count(*) AS INTEGER) AS rating_count
       FROM lineitem GROUP BY l_partkey""",
)
def rating_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rating_aggregate(read_table(spark, sf_dir, "lineitem"), "l_partkey", "l_quantity")


@query(
    "rating_agg_decimal",
    # Half-up to two digits in whole numbers, free of floating-point rounding.
    """SELECT l_partkey,
         CAST(CAST((200 * s + n) // (2 * n) AS DECIMAL(6,0)) / 100 AS DECIMAL(4,2)) AS avg_rating,
         CAST(n AS INTEGER) AS rating_count
       FROM (SELECT l_partkey, sum(CAST(l_quantity AS BIGINT))::BIGINT AS s, count(*) AS n
             FROM lineitem GROUP BY l_partkey)""",
)
def rating_agg_decimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "lineitem")
    return rating_aggregate(lines, "l_partkey", "l_quantity", "decimal(4,2)")


@query(
    "rating_agg_sql",
    """SELECT user_id, CAST(sum(CAST(value AS DECIMAL(12,2))) AS DECIMAL(22,2)) AS total_value,
         CAST(count(*) AS INTEGER) AS rating_count
       FROM events GROUP BY user_id""",
)
def rating_agg_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = (
        "SELECT e.user_id, SUM(e.value::NUMERIC(12,2))::NUMERIC(22,2) AS total_value, "
        "COUNT(*)::int4 AS rating_count FROM events e GROUP BY e.user_id"
    )
    return _sql(spark, sf_dir, text, "events")


@query(
    "rating_agg_cast",
    """SELECT user_id, CAST(avg(value) AS DOUBLE) AS avg_value, CAST(count(*) AS INTEGER) AS n,
         CAST(CAST(max(value) AS DECIMAL(38,18)) AS DOUBLE) AS top
       FROM events GROUP BY user_id""",
)
def rating_agg_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type names inside CAST, and a number type without digits."""
    text = (
        "SELECT user_id, CAST(AVG(value) AS float8) AS avg_value, CAST(COUNT(*) AS int4) AS n, "
        "CAST(MAX(value)::NUMERIC AS float8) AS top FROM events GROUP BY user_id"
    )
    return _sql(spark, sf_dir, text, "events")


@query(
    "join_inner",
    """SELECT c.c_name, o.o_orderkey, o.o_totalprice
       FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey""",
)
def join_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = (
        "SELECT c.c_name, o.o_orderkey, o.o_totalprice "
        "FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey"
    )
    return _sql(spark, sf_dir, text, "orders", "customer")


@query(
    "join_top",
    """SELECT p.p_name, l.l_quantity, l.l_orderkey, l.l_linenumber
       FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey
       ORDER BY p.p_name, l.l_quantity, l.l_orderkey, l.l_linenumber LIMIT 5""",
)
def join_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = (
        "SELECT p.p_name, l.l_quantity, l.l_orderkey, l.l_linenumber "
        "FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey "
        "ORDER BY p.p_name, l.l_quantity, l.l_orderkey, l.l_linenumber LIMIT 5"
    )
    return _sql(spark, sf_dir, text, "lineitem", "part")


@query(
    "join_lateral",
    """SELECT * FROM (SELECT l_partkey, avg(l_quantity) AS avg_rating FROM lineitem
         GROUP BY l_partkey) q CROSS JOIN LATERAL (SELECT q.avg_rating * 2 AS twice) s""",
)
def join_lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lateral SELECT without FROM: Catalyst turns it into a projection."""
    text = (
        "SELECT * FROM (SELECT l_partkey, avg(l_quantity) AS avg_rating FROM lineitem "
        "GROUP BY l_partkey) q CROSS JOIN LATERAL (SELECT q.avg_rating * 2 AS twice) s"
    )
    return _sql(spark, sf_dir, text, "lineitem")


@query(
    "table_counts",
    " UNION ALL ".join(
        f"SELECT '{name}' AS \"table\", count(*) AS \"rows\" FROM {name}" for name in TABLES
    ),
)
def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_counts({name: read_table(spark, sf_dir, name) for name in TABLES})


@query(
    "top_by_title",
    "SELECT p_partkey, p_name FROM part ORDER BY p_name, p_partkey LIMIT 5",
)
def top_by_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return top_rows(part, ["p_name", "p_partkey"], 5)


@query(
    "top_latest",
    """SELECT o_orderkey, o_custkey, o_orderdate FROM orders
       ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50""",
)
def top_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return top_rows(orders, [F.desc("o_orderdate"), F.desc("o_orderkey")], 50)


@query(
    "oldest_row",
    "SELECT * FROM orders ORDER BY o_orderdate NULLS FIRST, o_orderkey LIMIT 1",
)
def oldest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oldest_row(read_table(spark, sf_dir, "orders"), "o_orderdate", "o_orderkey")


@query(
    "last_per_job",
    """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (
         PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
       WHERE rn = 1""",
)
def last_per_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders")
    return last_per_group(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query(
    "latest_rows",
    """SELECT user_id, event_id, ts, event_type, value, sent FROM (
         SELECT *, count(*) OVER (PARTITION BY user_id) AS sent,
           row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
         FROM events) WHERE rn = 1""",
)
def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events").drop("props")
    return latest_rows(events, ["user_id"], ["ts", "event_id"]).withColumnRenamed("_sent", "sent")
