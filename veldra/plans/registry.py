"""All queries of the core and their SQL."""

from __future__ import annotations

from . import access_queries, evaluation_queries, ingest_queries, lexical_queries, orphan_queries, parsing_queries, retrieval_queries, search_queries

MODULES = (orphan_queries, lexical_queries, access_queries, ingest_queries, retrieval_queries, search_queries, evaluation_queries, parsing_queries)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.oracle_sql().items()}
