"""Row transforms, conforming and checks."""

from __future__ import annotations

from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marts.functions import document_id, jsonify
from marts.functions.text import WHITESPACE
from marts.operators import (
    apply_steps,
    check_keys,
    check_rules,
    film_dim,
    normalize_title,
    pandas_transform,
    rows_transform,
)
from marts.operators.conform import project
from marts.sources import read_table

from .registry import query

_WHITESPACE_SQL = " || ".join(f"chr({ord(c)})" for c in WHITESPACE)
_TITLE_SQL = f"""CASE WHEN length(title) > 0
    THEN 'TRANSFORMED_' || trim(title, {_WHITESPACE_SQL}) ELSE title END"""


def _films(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("film_id"),
        F.concat(F.lit(" \t"), "text", F.lit("\n　")).alias("title"),
        F.col("n_chars").alias("rating"),
        "lang",
    )


_FILMS_SQL = """SELECT doc_id AS film_id,
    ' ' || chr(9) || text || chr(10) || chr(12288) AS title, n_chars AS rating, lang
    FROM documents"""


@query(
    "normalize_title",
    f"SELECT film_id, {_TITLE_SQL} AS title, rating, lang FROM ({_FILMS_SQL})",
)
def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_title(_films(spark, sf_dir))


@query(
    "film_dim_transform",
    """SELECT p_partkey AS film_id, coalesce(p_name, '') AS title,
         CAST(p_size AS DOUBLE) AS rating FROM part""",
)
def film_dim_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read_table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("film_id"),
        F.col("p_name").alias("title"),
        F.col("p_size").alias("rating"),
        "p_brand",
    )
    return film_dim(part)


@query(
    "task_chain",
    f"""SELECT film_id, {_TITLE_SQL} AS title, CAST(rating AS DOUBLE) AS rating
        FROM ({_FILMS_SQL})""",
)
def task_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_steps(_films(spark, sf_dir), [film_dim, normalize_title])


@query(
    "batch_python_transform",
    """SELECT doc_id, line_no, lines[line_no] AS line FROM (
         SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS line_no
         FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))
       WHERE lines[line_no] <> ''""",
)
def batch_python_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Local functions travel to the workers by value, without this package.
    def lines(rows: list[dict[str, Any]]) -> list[dict[str, Any]]:
        return [
            {"doc_id": row["doc_id"], "line_no": number, "line": line}
            for row in rows
            for number, line in enumerate(row["text"].split("\n"), start=1)
            if line
        ]

    step = rows_transform(lines, "doc_id bigint, line_no bigint, line string")
    return apply_steps(read_table(spark, sf_dir, "documents").select("doc_id", "text"), [step])


@query(
    "pandas_transform",
    """SELECT doc_id, length(text) - length(replace(text, chr(10), '')) + 1 AS n_lines
       FROM documents""",
)
def pandas_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    def line_counts(frame: pd.DataFrame) -> pd.DataFrame:
        return frame.assign(n_lines=frame["text"].str.count("\n") + 1)[["doc_id", "n_lines"]]

    step = pandas_transform(line_counts, "doc_id bigint, n_lines bigint")
    return apply_steps(read_table(spark, sf_dir, "documents").select("doc_id", "text"), [step])


@query(
    "conform_target",
    """SELECT CAST(p_partkey AS VARCHAR) AS film_id, p_name AS title,
         CAST(NULL AS DECIMAL(3,1)) AS rating FROM part""",
)
def conform_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read_table(spark, sf_dir, "part").withColumnsRenamed(
        {"p_partkey": "film_id", "p_name": "title"}
    )
    schema = T.StructType.fromDDL("film_id string, title string, rating decimal(3,1)")
    return project(part, schema, required=("film_id", "title"))


@query(
    "jsonify_rows",
    """SELECT CAST(event_id AS VARCHAR) AS doc_id, user_id, value,
         strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN date_part('microsecond', ts) % 1000000 = 0
           THEN '' ELSE strftime(ts, '.%f') END AS ts,
         strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') AS whole_second,
         strftime(ts, '%Y-%m-%d') AS day, CAST(CAST(value AS DECIMAL(12,1)) AS DOUBLE) AS rounded
       FROM events""",
)
def jsonify_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events").select(
        document_id(F.col("event_id")).alias("doc_id"),
        "user_id",
        "value",
        "ts",
        F.date_trunc("second", "ts").cast("timestamp_ntz").alias("whole_second"),
        F.to_date("ts").alias("day"),
        F.col("value").cast("decimal(12,1)").alias("rounded"),
    )
    return jsonify(events)


@query(
    "check_rules",
    """SELECT 'quantity 1..40' AS rule, count(*) FILTER (NOT l_quantity BETWEEN 1 AND 40)
         AS violations FROM lineitem
       UNION ALL SELECT 'quantity is not null', count(*) FILTER (l_quantity IS NULL) FROM lineitem
       UNION ALL SELECT 'flag is A', count(*) FILTER (l_returnflag <> 'A') FROM lineitem""",
)
def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check_rules(
        read_table(spark, sf_dir, "lineitem"),
        {
            "quantity 1..40": "l_quantity BETWEEN 1 AND 40",
            "quantity is not null": "l_quantity IS NOT NULL",
            "flag is A": F.col("l_returnflag") == "A",
        },
    )


@query(
    "check_keys",
    """SELECT CAST(coalesce(sum(n) FILTER (l_orderkey IS NULL OR l_linenumber IS NULL), 0)
         AS BIGINT) AS null_keys,
         count(*) FILTER (l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL AND n > 1)
           AS duplicate_keys
       FROM (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL)""",
)
def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check_keys(read_table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])
