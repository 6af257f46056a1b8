"""All queries of the engine's own operators, by name, and their SQL."""

from __future__ import annotations

from . import graph_queries, history_queries, layer_queries, memory_queries, pack_queries, search_queries, stream_queries, text_queries, tree_queries

MODULES = (text_queries, layer_queries, pack_queries, search_queries, graph_queries, history_queries, memory_queries, stream_queries, tree_queries)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
