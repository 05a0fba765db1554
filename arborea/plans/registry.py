"""Queries over the given tables, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "audit_report"


def register(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"{name} is registered twice")
    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = sql


def _load() -> None:
    from . import content_queries, detail_queries, geometry_queries, layout_queries, move_queries, proposal_queries, region_queries, rewrite_queries, session_queries, structure_queries, table_queries, tagging_queries, text_queries, tree_queries  # noqa: F401


_load()
