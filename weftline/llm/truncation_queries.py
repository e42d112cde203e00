"""Queries of problem 3: texts cut off by field limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm.truncation import field_texts, rates, truncated_texts
from weftline.session import spread
from weftline.sources.tables import table


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    texts = field_texts(
        spread(table(spark, folder, "segment_states", "feed_id", "path", "source", "translation"), "feed_id"),
        table(spark, folder, "eval_items", "item", "blocks"),
        table(spark, folder, "eval_outputs", "out_id", "candidate", "item", "finals"),
        table(spark, folder, "gate_rows", "gate_id", "candidate", "issues"),
    )
    return truncated_texts(texts)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(spark, folder).filter("truncated").select("src", "row_id", "pos")


def p3_rates(spark: SparkSession, folder: str) -> DataFrame:
    return rates(_scored(spark, folder))


QUERIES = {"p3_found": p3_found, "p3_rates": p3_rates}
ORACLE: dict[str, str] = {}
