"""All queries of the core, with the SQL each must agree with."""

from __future__ import annotations

from weftline.plans import document_queries, evaluation_queries, incremental_queries, segment_queries, text_queries

_MODULES = (incremental_queries, segment_queries, text_queries, evaluation_queries, document_queries)


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in _MODULES for k, v in m.ORACLE.items()}
