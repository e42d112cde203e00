"""Queries of problem 8: encoding of the whole corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.encode import decoded, encode_column
from weftline.session import spread
from weftline.sources.tables import table


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_column(spread(table(spark, folder, "documents", "doc_id", "text"), "doc_id"), "doc_id", "text")


def p8_lengths(spark: SparkSession, folder: str) -> DataFrame:
    """Token counts a source: documents, ids, and the longest encoding."""
    ids = p8_ids(spark, folder).select("doc_id", F.size("ids").alias("n"))
    return ids.join(table(spark, folder, "documents", "doc_id", "source"), "doc_id").groupBy("source").agg(F.count("*").alias("documents"), F.sum("n").alias("ids"), F.max("n").alias("longest"))


def p8_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the ids of each document stand for its text, byte for byte; a null text stands for an empty one."""
    documents = spread(table(spark, folder, "documents", "doc_id", "text"), "doc_id")
    return decoded(encode_column(documents, "doc_id", "text").join(documents, "doc_id"), "doc_id", "ids", "text")


QUERIES = {"p8_ids": p8_ids, "p8_lengths": p8_lengths, "p8_round_trip": p8_round_trip}
ORACLE: dict[str, str] = {"p8_round_trip": "select doc_id, true as same from documents"}
