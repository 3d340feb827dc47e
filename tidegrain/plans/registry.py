"""All core queries and their SQL."""

from __future__ import annotations

from tidegrain.plans import analytics_queries, document_queries, memory_queries, page_queries, planning_queries, snapshot_queries

_MODULES = [snapshot_queries, analytics_queries, document_queries, memory_queries, page_queries, planning_queries]

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in _MODULES for name, sql in module.SQL.items()}
