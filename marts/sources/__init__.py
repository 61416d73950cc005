from .query import ordered_page, spark_cast_names, sql_source
from .tables import read_table, register_folder, register_table, register_views

__all__ = [
    "ordered_page",
    "read_table",
    "register_folder",
    "register_table",
    "register_views",
    "spark_cast_names",
    "sql_source",
]
