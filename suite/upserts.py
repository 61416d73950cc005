"""Targets: upserts, jobs, checkpoints, streaming, run history, reconciliation.

Every query works in a new folder below the session's shared folder.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marts.operators import (
    CursorColumns,
    GroupBy,
    backlog,
    key_differences,
    normalize_title,
    summary,
    upsert_rows,
)
from marts.plans import JobSpec, MartTable, RunHistory, Step, TargetSpec, run_job
from marts.session import new_folder
from marts.sources import read_table, register_folder, sql_source
from marts.streaming import file_stream, start_upsert

from .registry import ORACLES, query

NOW = datetime(2024, 6, 1, tzinfo=timezone.utc)
BY_DATE = CursorColumns("o_orderdate", "o_orderkey")

ITEMS = TargetSpec(
    name="items",
    key=("item_id",),
    schema="item_id BIGINT NOT NULL, title STRING NOT NULL, price DOUBLE, updated_at TIMESTAMP",
    required=("item_id", "title"),
    load_time="updated_at",
)
ITEM_DOCUMENTS = TargetSpec(
    name="item_documents", key=("item_id",), schema="item_id BIGINT, price FLOAT", mode="merge"
)
LINES = TargetSpec(
    name="lines",
    key=("l_orderkey", "l_linenumber"),
    schema="l_orderkey BIGINT NOT NULL, l_linenumber INT NOT NULL, l_partkey BIGINT, "
    "l_quantity DOUBLE, l_shipdate TIMESTAMP_NTZ",
)
PART_QUANTITIES = TargetSpec(
    name="part_quantities",
    key=("item_id",),
    schema="item_id BIGINT NOT NULL, avg_rating DOUBLE, rating_count INT, updated_at TIMESTAMP",
    load_time="updated_at",
)
ORDERS = TargetSpec(
    name="orders",
    key=("o_orderkey",),
    schema="o_orderkey BIGINT NOT NULL, o_custkey BIGINT, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ",
)
_ORDERS_SQL = "SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders"


def _table(spark: SparkSession, spec: TargetSpec) -> MartTable:
    return MartTable(spark, new_folder(spark, "query"), spec)


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("item_id"),
        F.col("p_name").alias("title"),
        F.col("p_retailprice").alias("price"),
        F.col("p_size").alias("size"),
        F.col("p_brand").alias("brand"),
    )


def aggregate_load(spark: SparkSession, sf_dir: str, root: str) -> DataFrame:
    """Quantities per part, loaded for the earlier lines, then for all lines
    shipped since: the second load overwrites the parts it meets."""
    register_folder(spark, sf_dir, ["lineitem"])
    text = (
        "SELECT l_partkey AS item_id, AVG(l_quantity)::float8 AS avg_rating, "
        "COUNT(*)::int AS rating_count FROM lineitem WHERE l_shipdate {} GROUP BY l_partkey"
    )
    for span in ("< TIMESTAMP '1997-01-01'", ">= TIMESTAMP '1996-01-01'"):
        job = JobSpec("part_quantities", text.format(span), PART_QUANTITIES)
        run_job(spark, job, root, now=NOW)
    return MartTable(spark, root, PART_QUANTITIES).read().drop("updated_at")


@query(
    "aggregate_load",
    """WITH a AS (SELECT l_partkey AS item_id, avg(l_quantity) AS avg_rating,
           CAST(count(*) AS INTEGER) AS rating_count
         FROM lineitem WHERE l_shipdate < TIMESTAMP '1997-01-01' GROUP BY l_partkey),
       b AS (SELECT l_partkey AS item_id, avg(l_quantity) AS avg_rating,
           CAST(count(*) AS INTEGER) AS rating_count
         FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' GROUP BY l_partkey)
       SELECT * FROM b UNION ALL
       SELECT * FROM a WHERE item_id NOT IN (SELECT item_id FROM b)""",
)
def aggregate_load_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate_load(spark, sf_dir, new_folder(spark, "query"))


@query(
    "upsert_replace",
    """SELECT p_partkey AS item_id, p_name AS title,
         CASE WHEN p_size > 40 THEN NULL WHEN p_size > 16 THEN p_retailprice + 1
              ELSE p_retailprice END AS price
       FROM part""",
)
def upsert_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inserted, overwritten (NULL included) and untouched rows."""
    items = _items(spark, sf_dir)
    table = _table(spark, ITEMS)
    table.upsert(items.where("size <= 33"), now=NOW)
    changed = items.where("size > 16").withColumn(
        "price", F.when(F.col("size") <= 40, F.col("price") + 1)
    )
    table.upsert(changed, now=NOW)
    return table.read().drop("updated_at")


@query(
    "upsert_load_time",
    """SELECT p_partkey AS item_id, p_name AS title, p_retailprice AS price,
         CASE WHEN p_size > 16 THEN TIMESTAMP '2024-06-01 00:00:00' ELSE TIMESTAMP '2024-05-01 00:00:00'
         END AS updated_at
       FROM part""",
)
def upsert_load_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The load time of each row's last run, whatever the rows say."""
    items = _items(spark, sf_dir).withColumn("updated_at", F.lit("1970-01-01").cast("timestamp"))
    table = _table(spark, ITEMS)
    table.upsert(items.where("size <= 33"), now=datetime(2024, 5, 1, tzinfo=timezone.utc))
    table.upsert(items.where("size > 16"), now=NOW)
    return table.read().withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz"))


@query(
    "upsert_column_case",
    "SELECT p_partkey AS item_id, p_name AS title, p_retailprice AS price FROM part",
)
def upsert_column_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns meet the target's by name without regard to case."""
    register_folder(spark, sf_dir, ["part"])
    text = "SELECT P_PARTKEY AS ITEM_ID, P_NAME AS title, P_RETAILPRICE AS PRICE FROM part"
    rows = sql_source(spark, text)
    table = _table(spark, ITEMS)
    table.upsert(rows, now=NOW)
    return table.read().drop("updated_at")


@query(
    "upsert_documents_decimal_id",
    """SELECT CAST(l_orderkey + 9007199254740992 AS VARCHAR) AS order_id,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(20,2))) AS DECIMAL(20,2)) AS price
       FROM lineitem GROUP BY l_orderkey""",
)
def upsert_documents_decimal_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decimal ids become text, and declared decimals keep their digits."""
    spec = TargetSpec("orders_by_id", ("order_id",), "price DECIMAL(20,2)", mode="merge")
    rows = read_table(spark, sf_dir, "lineitem").groupBy(
        (F.col("l_orderkey").cast("decimal(20,0)") + F.lit(2**53).cast("decimal(20,0)"))
        .cast("decimal(20,0)")
        .alias("order_id")
    ).agg(F.sum(F.col("l_extendedprice").cast("decimal(20,2)")).cast("decimal(20,2)").alias("price"))
    table = _table(spark, spec)
    table.upsert(rows)
    return table.read()


@query(
    "upsert_merge",
    """SELECT p_partkey AS item_id, CAST(CASE WHEN p_size <= 33 THEN p_retailprice END AS FLOAT)
         AS price,
         CASE WHEN p_size > 16 THEN p_name || '*' ELSE p_name END AS title,
         CASE WHEN p_size > 16 THEN p_brand END AS brand
       FROM part""",
)
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second load has no price and a new column: old prices stay."""
    items = _items(spark, sf_dir)
    table = _table(spark, ITEM_DOCUMENTS)
    table.upsert(items.where("size <= 33").select("item_id", "price", "title"))
    changed = items.where("size > 16").withColumn("title", F.concat("title", F.lit("*")))
    table.upsert(changed.select("item_id", "title", "brand"))
    return table.read()


@query(
    "upsert_documents",
    """SELECT user_id, arg_max(event_id, ts) AS event_id,
         strftime(max(ts), '%Y-%m-%dT%H:%M:%S') ||
           CASE WHEN date_part('microsecond', max(ts)) % 1000000 = 0 THEN ''
                ELSE strftime(max(ts), '.%f') END AS ts
       FROM events GROUP BY user_id""",
)
def upsert_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a declared schema: timestamps are stored as ISO text."""
    events = read_table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    table = _table(spark, TargetSpec(name="last_events", key=("user_id",), mode="merge"))
    table.upsert(events, order=("ts",))
    return table.read()


@query(
    "upsert_documents_widening",
    """SELECT p_partkey AS item_id,
         CASE WHEN p_size > 40 THEN CAST(p_retailprice AS DOUBLE) ELSE CAST(p_size AS DOUBLE) END AS amount,
         CASE WHEN p_size > 16 AND p_size <= 40 THEN CAST(p_partkey + 3000000000 AS BIGINT)
           ELSE p_size END AS code
       FROM part""",
)
def upsert_documents_widening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field without a declared type grows: int, then bigint, then double; files
    written before are read through the wider type."""
    part = read_table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "item_id")
    small, size = F.col("p_size") <= 16, F.col("p_size").cast("int")
    table = _table(spark, TargetSpec("amounts", ("item_id",), mode="merge"))
    table.upsert(part.where(small).select("item_id", size.alias("amount"), size.alias("code")))
    rest = part.where(~small)
    table.upsert(
        rest.where("p_size <= 40").select(
            "item_id", size.cast("long").alias("amount"), (F.col("item_id") + 3_000_000_000).alias("code")
        )
    )
    table.upsert(
        rest.where("p_size > 40").select(
            "item_id", F.col("p_retailprice").alias("amount"), size.alias("code")
        )
    )
    return table.read()


@query(
    "upsert_last_write_wins",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_shipdate FROM (
         SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
           ORDER BY l_shipdate DESC, l_partkey DESC, l_quantity DESC) AS rn FROM lineitem)
       WHERE rn = 1""",
)
def upsert_last_write_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, LINES)
    lines = read_table(spark, sf_dir, "lineitem")
    table.upsert(lines, order=("l_shipdate", "l_partkey", "l_quantity"))
    return table.read()


@query(
    "upsert_idempotent",
    "SELECT p_partkey AS item_id, p_name AS title, p_retailprice AS price FROM part",
)
def upsert_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir)
    table = _table(spark, ITEMS)
    table.upsert(items, now=NOW)
    table.upsert(items, now=NOW)
    return table.read().drop("updated_at")


@query(
    "upsert_rows",
    """SELECT coalesce(n.o_custkey, o.c_custkey) AS c_custkey, o.c_name,
         n.orders FROM customer o FULL JOIN (SELECT o_custkey, count(*) AS orders FROM orders
         GROUP BY o_custkey) n ON o.c_custkey = n.o_custkey""",
)
def merge_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merge alone, on two frames."""
    customers = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    orders = read_table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey"))
    return upsert_rows(customers, orders.agg(F.count("*").alias("orders")), ["c_custkey"])


def _orders_job(spark: SparkSession, sf_dir: str, **options) -> JobSpec:
    register_folder(spark, sf_dir, ["orders"])
    return JobSpec(
        "orders", "SELECT * FROM orders", ORDERS, mode="incremental", cursor=BY_DATE, **options
    )


def _third(spark: SparkSession, sf_dir: str) -> int:
    return max(1, read_table(spark, sf_dir, "orders").count() // 3)


@query("inc_drain_equals_full", _ORDERS_SQL)
def inc_drain_equals_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    job = _orders_job(spark, sf_dir, max_rows=_third(spark, sf_dir))
    root = new_folder(spark, "query")
    run_job(spark, job, root)
    return MartTable(spark, root, ORDERS).read()


@query("inc_drain_staged", _ORDERS_SQL)
def inc_drain_staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    job = _orders_job(spark, sf_dir, max_rows=_third(spark, sf_dir), stage_backlog=True)
    root = new_folder(spark, "query")
    run_job(spark, job, root)
    return MartTable(spark, root, ORDERS).read()


@query("inc_stop_and_resume", _ORDERS_SQL)
def inc_stop_and_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stopped after the first slice, finished by a second run."""
    root = new_folder(spark, "query")
    first = _orders_job(spark, sf_dir, max_rows=_third(spark, sf_dir))
    run_job(spark, first, root, should_stop=lambda: True)
    run_job(spark, _orders_job(spark, sf_dir), root)
    return MartTable(spark, root, ORDERS).read()


@query("inc_norows", "SELECT * FROM orders WHERE false")
def inc_norows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After a run the cursor leaves nothing to read."""
    job = _orders_job(spark, sf_dir)
    root = new_folder(spark, "query")
    run_job(spark, job, root)
    cursor = MartTable(spark, root, ORDERS).cursor(job.job_id)
    return backlog(read_table(spark, sf_dir, "orders"), BY_DATE, cursor)


@query(
    "inc_affected_groups",
    """SELECT o_custkey, CAST(count(*) AS BIGINT) AS orders, max(o_totalprice) AS largest,
         max(o_orderdate) AS last_date
       FROM orders GROUP BY o_custkey""",
)
def inc_affected_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loaded up to a date first; the second run computes only the customers with later orders."""
    rows = read_table(spark, sf_dir, "orders")
    middle = rows.agg(F.expr("percentile_approx(o_orderkey, 0.98)")).first()[0]
    rows = rows.select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    target = TargetSpec(
        "customers", ("o_custkey",),
        "o_custkey BIGINT, orders BIGINT, largest DOUBLE, last_date TIMESTAMP_NTZ",
    )
    grouping = GroupBy(
        ("o_custkey",),
        {"orders": "count(*)", "largest": "max(o_totalprice)", "last_date": "max(o_orderdate)"},
    )
    # The changes of a table arrive in key order here: the loading time is the cursor.
    arrived = rows.withColumn("arrived", F.timestamp_seconds("o_orderkey").cast("timestamp_ntz"))
    root = new_folder(spark, "query")
    for part in (arrived.where(F.col("o_orderkey") <= middle), arrived):
        part.createOrReplaceTempView("arrived_orders")
        job = JobSpec(
            "customers", "SELECT * FROM arrived_orders", target, mode="incremental",
            cursor=CursorColumns("arrived", "o_orderkey"), group_by=grouping,
        )
        run_job(spark, job, root)
    return MartTable(spark, root, target).read()


@query(
    "inc_aggregate_job",
    """SELECT user_id, max(ts) AS last_ts, CAST(count(*) AS INTEGER) AS n
       FROM events GROUP BY user_id""",
)
def inc_aggregate_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An aggregate as incremental source, staged so that it is computed once."""
    register_folder(spark, sf_dir, ["events"])
    users = read_table(spark, sf_dir, "events").agg(F.count_distinct("user_id")).first()[0]
    target = TargetSpec("users", ("user_id",), "user_id BIGINT, last_ts TIMESTAMP_NTZ, n INT")
    job = JobSpec(
        "users",
        "SELECT user_id, max(ts) AS last_ts, count(*)::int AS n FROM events GROUP BY user_id",
        target,
        mode="incremental",
        cursor=CursorColumns("last_ts", "user_id"),
        max_rows=max(1, users // 2),
        stage_backlog=True,
    )
    root = new_folder(spark, "query")
    run_job(spark, job, root)
    return MartTable(spark, root, target).read()


@query(
    "task_target_override",
    """SELECT p_partkey AS item_id, CASE WHEN length(p_name) > 0
         THEN 'TRANSFORMED_' || trim(p_name) ELSE p_name END AS title, p_retailprice AS price
       FROM part""",
)
def task_target_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last step sends the rows to another target than the job's."""
    register_folder(spark, sf_dir, ["part"])
    job = JobSpec(
        "titles",
        "SELECT p_partkey AS item_id, p_name AS title, p_retailprice AS price FROM part",
        PART_QUANTITIES,
        steps=(Step(normalize_title, target=ITEMS),),
    )
    root = new_folder(spark, "query")
    run_job(spark, job, root, now=NOW)
    return MartTable(spark, root, ITEMS).read().drop("updated_at")


@query("reset_target", _ORDERS_SQL)
def reset_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reset takes the checkpoint with it: the next run loads everything again."""
    root = new_folder(spark, "query")
    job = _orders_job(spark, sf_dir)
    run_job(spark, job, root)
    table = MartTable(spark, root, ORDERS)
    table.reset()
    run_job(spark, job, root)
    return table.read()


@query("inc_empty_step", f"{_ORDERS_SQL} WHERE o_orderdate >= TIMESTAMP '1996-01-01'")
def inc_empty_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run whose step drops every row still advances: the next one reads the rest."""
    register_folder(spark, sf_dir, ["orders"])
    root = new_folder(spark, "query")
    nothing = Step(lambda rows: rows.where("o_totalprice < 0"))
    for text, steps in (
        ("SELECT * FROM orders WHERE o_orderdate < TIMESTAMP_NTZ '1996-01-01'", (nothing,)),
        ("SELECT * FROM orders", ()),
    ):
        run_job(spark, JobSpec("orders", text, ORDERS, "incremental", BY_DATE, steps=steps), root)
    return MartTable(spark, root, ORDERS).read()


@query(
    "stream_upsert",
    """SELECT user_id, event_id, ts, event_type, value FROM (
         SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS rn FROM events)
       WHERE rn = 1""",
)
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last event per user from a folder of files, two files per micro-batch."""
    events = read_table(spark, sf_dir, "events")
    root = new_folder(spark, "query")
    # One file per range, in time order: files are taken oldest first.
    for part, (low, high) in enumerate(_quarters(events)):
        span = events.where((F.col("ts") >= low) & (F.col("ts") < high))
        span.write.mode("append").parquet(f"{root}/source")
    target = TargetSpec(
        "last_events",
        ("user_id",),
        "user_id BIGINT, event_id BIGINT, ts TIMESTAMP_NTZ, event_type STRING, value DOUBLE",
    )
    table = MartTable(spark, root, target)
    stream = file_stream(spark, f"{root}/source", events.schema, max_files=2)
    start_upsert(stream, table, "events", f"{root}/checkpoint", order=("ts",)).awaitTermination()
    return table.read()


@query("stream_late_rows", ORACLES["stream_upsert"])
def stream_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest files come first, several per write: the last event still wins."""
    events = read_table(spark, sf_dir, "events")
    root = new_folder(spark, "query")
    for low, high in reversed(_quarters(events)):
        span = events.where((F.col("ts") >= low) & (F.col("ts") < high))
        span.repartition(3).write.mode("append").parquet(f"{root}/source")
    target = TargetSpec(
        "last_events",
        ("user_id",),
        "user_id BIGINT, event_id BIGINT, ts TIMESTAMP_NTZ, event_type STRING, value DOUBLE",
    )
    table = MartTable(spark, root, target)
    stream = file_stream(spark, f"{root}/source", events.schema, max_files=2)
    start_upsert(stream, table, "events", f"{root}/checkpoint", order=("ts",)).awaitTermination()
    return table.read()


def _quarters(events: DataFrame) -> list[tuple]:
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    step = (last - first) / 4
    edges = [first, first + step, first + 2 * step, first + 3 * step]
    ends = [*edges[1:], last + step]
    return [
        tuple(F.lit(edge.isoformat(timespec="microseconds")).cast("timestamp_ntz") for edge in pair)
        for pair in zip(edges, ends)
    ]


@query(
    "run_history",
    """SELECT 'orders' AS job_id, 'SUCCESS' AS status, count(*) AS rows_read,
         count(*) AS rows_written FROM orders
       UNION ALL SELECT 'orders', 'SUCCESS', 0, 0
       UNION ALL SELECT 'items', 'SUCCESS', count(*), count(*) FROM part""",
)
def run_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = new_folder(spark, "query")
    register_folder(spark, sf_dir, ["part"])
    job = _orders_job(spark, sf_dir)
    run_job(spark, job, root)
    run_job(spark, job, root)
    items = "SELECT p_partkey AS item_id, p_name AS title FROM part"
    run_job(spark, JobSpec("items", items, ITEMS), root, now=NOW)
    return RunHistory(spark, root).read().select("job_id", "status", "rows_read", "rows_written")


@query(
    "reconcile_summary",
    """SELECT 'source' AS side, count(*) AS "rows", min(p_partkey) AS lowest,
         max(p_partkey) AS highest FROM part
       UNION ALL SELECT 'target', count(*), min(p_partkey), max(p_partkey)
         FROM part WHERE p_size > 16""",
)
def reconcile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir)
    table = _table(spark, ITEMS)
    table.upsert(items.where("size > 16"), now=NOW)
    return summary(items, table.read(), "item_id")


@query(
    "reconcile_keys",
    """SELECT p_partkey AS item_id, CASE WHEN p_size <= 16 THEN 'missing'
         WHEN p_size > 40 THEN 'extra' ELSE 'changed' END AS difference
       FROM part WHERE NOT p_size BETWEEN 17 AND 33""",
)
def reconcile_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir)
    table = _table(spark, ITEMS)
    stored = items.where("size > 16").withColumn(
        "price", F.when(F.col("size") <= 33, F.col("price"))
    )
    table.upsert(stored, now=NOW)
    return key_differences(
        items.where("size <= 40"), table.read(), ["item_id"], ["title", "price"]
    )
