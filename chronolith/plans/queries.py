"""All queries of the time-series operators."""

from __future__ import annotations

from . import aggregate_queries, frame_queries, function_queries, io_queries, join_queries, ml_queries, stat_queries, window_queries  # noqa: F401
from .registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
