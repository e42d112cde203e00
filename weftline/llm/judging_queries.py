"""Queries of problems 5 and 6: consensus of judges, and one ranking of all systems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.consensus import Consensus, judge_ballots
from weftline.llm.ranking import rank
from weftline.session import checkpoint
from weftline.sources.tables import table

_COLUMNS = ("vote_id", "pick_id", "judge", "judge_model", "shown_order", "verdicts")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    labels, _ = Consensus(judge_ballots(table(spark, folder, "judge_pairs", *_COLUMNS))).run()
    return labels.select(F.col("item").cast("bigint").alias("pick_id"), "label")


def p5_calibrated(spark: SparkSession, folder: str) -> DataFrame:
    """A second consensus, by vote weights calibrated against the spectral one."""
    run = Consensus(judge_ballots(table(spark, folder, "judge_pairs", *_COLUMNS)))
    labels, _ = run.run()
    return (run.calibrated(checkpoint(labels)) if run.labels else labels).select(F.col("item").cast("bigint").alias("pick_id"), "label")


def p5_annotators(spark: SparkSession, folder: str) -> DataFrame:
    """Reliability of each annotator, 1 for one that is always right, below 0 for one that turns labels round."""
    run = Consensus(judge_ballots(table(spark, folder, "judge_pairs", *_COLUMNS)))
    _, weights = run.run()
    return weights.select("annotator", "reliability").join(run.votes.groupBy("annotator").agg(F.count("*").alias("votes")), "annotator")


def p5_agreement(spark: SparkSession, folder: str) -> DataFrame:
    run = Consensus(judge_ballots(table(spark, folder, "judge_pairs", *_COLUMNS)))
    labels, _ = run.run()
    return run.agreement(labels).withColumnRenamed("item", "pick_id")


def _ranked(spark: SparkSession, folder: str) -> DataFrame:
    pairs = table(spark, folder, "judge_pairs", *_COLUMNS, "baseline", "candidate")
    labels, _ = Consensus(judge_ballots(pairs)).run()
    met = pairs.groupBy("pick_id", "baseline", "candidate").agg(F.lit(1).alias("_one")).drop("_one")
    score = F.when(F.col("label") == "baseline", 1.0).when(F.col("label") == "candidate", 0.0).when(F.col("label") == "tie", 0.5)
    return rank(met.join(labels.withColumnRenamed("item", "pick_id"), "pick_id", "left").select(F.col("baseline").alias("left"), F.col("candidate").alias("right"), score.alias("score")))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _ranked(spark, folder).select("system", "rank_no")


def p6_strengths(spark: SparkSession, folder: str) -> DataFrame:
    return _ranked(spark, folder)


QUERIES = {"p5_found": p5_found, "p5_calibrated": p5_calibrated, "p5_annotators": p5_annotators, "p5_agreement": p5_agreement, "p6_found": p6_found, "p6_strengths": p6_strengths}
ORACLE: dict[str, str] = {}
