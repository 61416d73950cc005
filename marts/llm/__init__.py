"""Operators for large training corpora: formatting, deduplication, filtering, packing.

Each module holds one operator with a general interface; :mod:`marts.llm.queries`
applies them to the given tables. Nothing outside this package imports it.
"""
