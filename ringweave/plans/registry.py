"""Queries over the driver's tables and their SQL, gathered from the plan modules."""

from __future__ import annotations

from . import artifact_queries, evaluation_queries, function_queries, graph_queries, quality_queries, set_queries, stale_queries, state_queries, table_queries, text_queries

_PARTS = (table_queries, graph_queries, set_queries, text_queries, function_queries, quality_queries, evaluation_queries, state_queries, artifact_queries, stale_queries)
QUERIES: dict = {k: v for m in _PARTS for k, v in m.Q.items()}
SQL: dict[str, str] = {k: v for m in _PARTS for k, v in m.SQL.items()}
