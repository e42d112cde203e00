"""Queries of problem 9: evaluation texts leaking into training text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.leakage import find_leaks
from weftline.session import spread
from weftline.sources.tables import table


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    documents = spread(table(spark, folder, "documents", "doc_id", "text"), "doc_id")
    return find_leaks(documents, "doc_id", "text", table(spark, folder, "heldout_items"), "item_id", "text")


def p9_items(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that each leaked item got into."""
    leaks = p9_found(spark, folder).groupBy("item_id").agg(F.count("*").alias("documents"))
    return leaks.join(table(spark, folder, "heldout_items", "item_id", "suite"), "item_id")


QUERIES = {"p9_found": p9_found, "p9_items": p9_items}
ORACLE: dict[str, str] = {}
