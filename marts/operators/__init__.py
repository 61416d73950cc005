from .aggregates import last_per_group, oldest_row, rating_aggregate, table_counts, top_rows
from .checks import check_keys, check_rules
from .cursor import (
    Cursor,
    CursorColumns,
    backlog,
    check_cursor_columns,
    first_rows,
    later,
    slice_bounds,
)
from .groups import GroupBy
from .merge import latest_rows, upsert_rows
from .reconcile import key_differences, summary
from .slices import Slice, plan_slices
from .transforms import (
    apply_steps,
    film_dim,
    normalize_title,
    pandas_transform,
    rows_transform,
)

__all__ = [
    "Cursor",
    "CursorColumns",
    "GroupBy",
    "Slice",
    "apply_steps",
    "backlog",
    "check_cursor_columns",
    "check_keys",
    "check_rules",
    "film_dim",
    "first_rows",
    "key_differences",
    "last_per_group",
    "later",
    "latest_rows",
    "normalize_title",
    "oldest_row",
    "pandas_transform",
    "plan_slices",
    "rating_aggregate",
    "rows_transform",
    "slice_bounds",
    "summary",
    "table_counts",
    "top_rows",
    "upsert_rows",
]
