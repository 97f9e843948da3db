"""Named queries of the library and the SQL that an independent engine runs for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import answer_queries, graph_queries, report_queries, session_queries, synthesis_queries, text_queries  # noqa: F401
from .plans.registry import QUERIES, SQL


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
