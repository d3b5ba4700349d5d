"""All queries of the core, with the SQL that gives the same rows."""

from __future__ import annotations

from parleyspark.plans import archive_queries, graph_queries, hierarchy_queries, nested_queries, text_queries

_MODULES = [hierarchy_queries, nested_queries, archive_queries, text_queries, graph_queries]

QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in _MODULES for k, v in m.SQL.items()}
