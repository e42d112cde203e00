"""All queries of the subpackage, with the SQL each must agree with."""

from __future__ import annotations

from weftline.llm import bitext_queries, encode_queries, judging_queries, leakage_queries, markup_queries, pairs_queries, repetition_queries, truncation_queries

_MODULES = (markup_queries, encode_queries, pairs_queries, truncation_queries, bitext_queries, judging_queries, leakage_queries, repetition_queries)


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in _MODULES for k, v in m.ORACLE.items()}
