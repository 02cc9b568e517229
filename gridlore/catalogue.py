"""All queries of the relational part of the library, with the SQL they are held against."""

from __future__ import annotations

from .plans import export_queries, grid_queries, history_queries, region_queries, report_queries

_PARTS = (history_queries, grid_queries, report_queries, region_queries, export_queries)


def queries() -> dict:
    return {name: query for part in _PARTS for name, query in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.SQL.items()}
