"""Session helpers: defaults for local use and lineage cuts that survive lost executors."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings for a local session. A cluster's own settings are never overridden.
LOCAL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    build = SparkSession.builder.master(f"local[{cores}]").appName("weftline").config("spark.driver.memory", memory).config("spark.sql.shuffle.partitions", str(partitions))
    for key, value in LOCAL_SETTINGS.items():
        build = build.config(key, value)
    return build.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; a temporary folder only where that is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    found = "file://" + tempfile.mkdtemp(prefix="weftline-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def scratch(spark: SparkSession) -> str:
    """A new path in the application's part of the shared folder."""
    return f"{shared_dir(spark)}/weftline-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows to a table in the shared folder, in one pass, and read them back.

    Unlike DataFrame.checkpoint() the rows are computed once, not twice, and size estimates start anew, which
    otherwise multiply from join to join of a loop. The tables of an application share one folder, <shared>/<id>.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Use all cores for a Python stage when the files give fewer splits than there are cores; otherwise no shuffle is added."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def package_root() -> str:
    return os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
