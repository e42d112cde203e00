"""Queries of problem 4: broken prompt and response pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.pairs import flag_pairs
from weftline.session import checkpoint, spread
from weftline.sources.tables import table


def _flagged(spark: SparkSession, folder: str) -> DataFrame:
    pairs = spread(table(spark, folder, "translation_pairs", "pair_id", "source", "translation", "target_lang"), "pair_id")
    return flag_pairs(pairs, "pair_id", "source", "translation", "target_lang")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _flagged(spark, folder).filter("defect is not null")


def p4_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of each defect, and their share."""
    counts = checkpoint(_flagged(spark, folder).groupBy(F.coalesce("defect", F.lit("sound")).alias("defect")).agg(F.count("*").alias("pairs")))
    total = counts.agg(F.sum("pairs")).first()[0]
    return counts.select("defect", "pairs", F.try_divide("pairs", F.lit(total)).alias("share"))


QUERIES = {"p4_found": p4_found, "p4_rates": p4_rates}
ORACLE: dict[str, str] = {}
