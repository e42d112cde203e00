"""Queries of problem 10: repetition inside a single document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm.repetition import host_rates, repetition, shares
from weftline.session import spread
from weftline.sources.tables import table


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents", "doc_id", "text", "source"), "doc_id")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose passages make up the share, and those of bad hosts that reach it with short phrases."""
    return repetition(_documents(spark, folder)).filter("repetitive").select("doc_id")


def p10_shares(spark: SparkSession, folder: str) -> DataFrame:
    return repetition(_documents(spark, folder))


def p10_hosts(spark: SparkSession, folder: str) -> DataFrame:
    return host_rates(shares(_documents(spark, folder), "doc_id", "text", "source"))


QUERIES = {"p10_found": p10_found, "p10_shares": p10_shares, "p10_hosts": p10_hosts}
ORACLE: dict[str, str] = {}
