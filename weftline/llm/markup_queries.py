"""Queries of problem 1: markup residue in text documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm.markup import clean_text, find_markup
from weftline.session import spread
from weftline.sources.tables import table


def _blocks(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "raw_blocks", "raw_id", "source", "translation"), "raw_id")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return find_markup(_blocks(spark, folder), "raw_id")


def p1_clean(spark: SparkSession, folder: str) -> DataFrame:
    return clean_text(_blocks(spark, folder), "raw_id")


QUERIES = {"p1_found": p1_found, "p1_clean": p1_clean}
ORACLE: dict[str, str] = {}
