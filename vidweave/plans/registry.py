"""All queries over the given tables, and their DuckDB oracles, gathered from the query modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def _modules() -> list:
    from . import admin_queries, document_queries, export_queries, interval_queries, relational_queries, retrieval_queries, stream_queries, text_queries, version_queries

    return [text_queries, retrieval_queries, interval_queries, relational_queries, document_queries, export_queries, version_queries, admin_queries, stream_queries]


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for m in _modules():
        out.update(m.QUERIES)
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _modules():
        out.update(m.ORACLES)
    return out
