"""Queries of problem 7: sentence alignment in bilingual documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.bitext import align_documents
from weftline.session import spread
from weftline.sources.tables import table


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return align_documents(spread(table(spark, folder, "bitexts", "bitext_id", "source", "translation"), "bitext_id"), "bitext_id")


def p7_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences and matched sentences of each document."""
    links = p7_found(spark, folder).groupBy("bitext_id").agg(F.countDistinct("source_idx").alias("source_matched"), F.countDistinct("translation_idx").alias("translation_matched"))
    sizes = table(spark, folder, "bitexts", "bitext_id", "source", "translation").select("bitext_id", F.size("source").alias("source_sentences"), F.size("translation").alias("translation_sentences"))
    return sizes.join(links, "bitext_id", "left").na.fill(0, ["source_matched", "translation_matched"])


QUERIES = {"p7_found": p7_found, "p7_coverage": p7_coverage}
ORACLE: dict[str, str] = {}
