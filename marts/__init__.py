"""Build and maintain analytical tables incrementally on Spark."""

from .operators import Cursor, CursorColumns, GroupBy
from .plans import JobSpec, MartTable, RunHistory, Step, TargetSpec, run_job
from .session import build_session
from .sources import register_folder, register_table, register_views, sql_source

__all__ = [
    "Cursor",
    "CursorColumns",
    "GroupBy",
    "JobSpec",
    "MartTable",
    "RunHistory",
    "Step",
    "TargetSpec",
    "build_session",
    "register_folder",
    "register_table",
    "register_views",
    "run_job",
    "sql_source",
]
