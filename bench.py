"""Headline measurements; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores. All steps run
once beforehand in another folder, so that the figures are those of a session
that has compiled its code; each figure is then one run.
"""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time
from datetime import datetime, timezone

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from marts.operators import CursorColumns  # noqa: E402
from marts.plans import JobSpec, MartTable, TargetSpec, run_job  # noqa: E402
from marts.session import build_session  # noqa: E402
from marts.sources import register_folder  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
NOW = datetime(2024, 6, 1, tzinfo=timezone.utc)

LINES = TargetSpec(
    "lines",
    ("l_orderkey", "l_linenumber"),
    "l_orderkey BIGINT NOT NULL, l_linenumber INT NOT NULL, l_partkey BIGINT, l_suppkey BIGINT, "
    "l_quantity DOUBLE, l_extendedprice DOUBLE, l_shipdate TIMESTAMP_NTZ",
)
PARTS = TargetSpec(
    "part_quantities", ("item_id",), "item_id BIGINT NOT NULL, avg_rating DOUBLE, rating_count INT"
)
ORDERS = TargetSpec(
    "orders",
    ("o_orderkey",),
    "o_orderkey BIGINT NOT NULL, o_custkey BIGINT, o_totalprice DOUBLE, o_orderdate TIMESTAMP_NTZ",
)
BY_DATE = CursorColumns("o_orderdate", "o_orderkey")


def main() -> None:
    spark = build_session(
        "marts-bench",
        master=f"local[{CPUS}]",
        **{
            "spark.sql.shuffle.partitions": CPUS,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    register_folder(spark, SF_DIR, ["lineitem", "orders"])
    last = spark.table("orders").selectExpr("percentile_approx(o_orderdate, 0.99)").first()[0]
    base = tempfile.mkdtemp(prefix="bench-")
    measure(spark, f"{base}/warm", last)
    seconds, rows = measure(spark, f"{base}/run", last)
    spark.stop()
    shutil.rmtree(base)
    print(
        json.dumps(
            {
                "metric": "job_wall_time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "rows_read": rows,
                "sf": os.path.basename(SF_DIR.rstrip("/")),
                "cpus": int(CPUS),
            }
        )
    )


def measure(
    spark: SparkSession, root: str, last: datetime
) -> tuple[dict[str, float], dict[str, int]]:
    orders = spark.table("orders").count()
    lines = JobSpec(
        "lines", "SELECT * FROM lineitem", LINES, order=("l_shipdate", "l_partkey", "l_quantity")
    )
    parts = JobSpec(
        "parts",
        "SELECT l_partkey AS item_id, AVG(l_quantity) AS avg_rating, COUNT(*)::int AS rating_count "
        "FROM lineitem GROUP BY l_partkey",
        PARTS,
    )

    def order_job(query: str = "SELECT * FROM orders", **options) -> JobSpec:
        return JobSpec("orders", query, ORDERS, mode="incremental", cursor=BY_DATE, **options)

    # Rows before the last percent first, then all of them: the second run reads
    # and upserts the last percent.
    early = order_job(f"SELECT * FROM orders WHERE o_orderdate <= TIMESTAMP_NTZ'{last}'")
    steps = {
        "full_load": lambda: run_job(spark, lines, root, now=NOW),
        "full_reload": lambda: run_job(spark, lines, root, now=NOW),
        "aggregate_load": lambda: run_job(spark, parts, root, now=NOW),
        "incremental_first_run": lambda: run_job(spark, early, root),
        "incremental_one_percent": lambda: run_job(spark, order_job(), root),
        "no_change_rerun": lambda: run_job(spark, order_job(), root),
        "drain_four_slices": lambda: run_job(
            spark, order_job(max_rows=max(1, orders // 4 + 1)), f"{root}/drain"
        ),
        "read_target": lambda: MartTable(spark, root, LINES)
        .read()
        .write.format("noop").mode("overwrite").save(),
    }
    seconds: dict[str, float] = {}
    rows: dict[str, int] = {}
    for name, step in steps.items():
        start = time.perf_counter()
        result = step()
        seconds[name] = round(time.perf_counter() - start, 3)
        rows[name] = getattr(result, "rows_read", 0)
    return seconds, rows


if __name__ == "__main__":
    main()
