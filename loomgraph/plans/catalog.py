"""Registered queries over the driver tables and their SQL equivalents."""

from __future__ import annotations

from . import extract_queries, graph_queries, table_queries

_PARTS = (graph_queries, table_queries, extract_queries)


def queries() -> dict:
    return {k: v for p in _PARTS for k, v in p.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for p in _PARTS for k, v in p.SQL.items()}
