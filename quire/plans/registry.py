"""All queries of the library by name, with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .answer_queries import answer_queries
from .glyph_queries import glyph_queries
from .library_queries import library_queries
from .more_queries import more_queries
from .search_queries import search_queries
from .store_queries import store_queries
from .structure_queries import structure_queries
from .text_queries import text_queries
from .thread_queries import thread_queries


def _all() -> dict:
    return search_queries() | library_queries() | structure_queries() | text_queries() | more_queries() | thread_queries() | store_queries() | glyph_queries() | answer_queries()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _all().items() if sql}
