"""Structured Streaming: segment states merged batch by batch, job states from progress events, windowed counts."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.operators.state import latest


def read_stream(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


#: Buckets of keys of a merged table; a batch writes only those it touches.
BUCKETS = 16


def merge_states(stream: DataFrame, target: str, checkpoint: str, key: list[str], order: str, buckets: int = BUCKETS):
    """Start a query that keeps the latest row of each key.

    Rows lie in buckets by the hash of their key. A batch writes new files of the buckets it touches, data/<batch>/bucket=<b>, and then a
    manifest, versions/<batch>.json, that names the newest files of every bucket; untouched buckets stay as they are. A batch run again after a
    failure writes the same files and manifest again, so each row counts once. Files that no manifest names any more are deleted two batches later.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = [n for n in versions(spark, target) if n < number]
        held = _manifest(spark, target, known[-1]) if known else {}
        placed = batch.withColumn("bucket", F.pmod(F.hash(*key), F.lit(buckets)))
        touched = sorted(r[0] for r in placed.select("bucket").distinct().collect())
        before = [held[str(b)] for b in touched if str(b) in held]
        columns = batch.columns
        rows = placed.select("bucket", *columns)
        for path, group in _by_folder(before).items():
            rows = rows.unionByName(spark.read.option("basePath", path).parquet(*group).select("bucket", *columns))
        latest(rows, ["bucket", *key], order).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/data/{number}")
        _write(spark, f"{target}/versions/{number}.json", json.dumps(held | {str(b): f"{target}/data/{number}/bucket={b}" for b in touched}))
        _sweep(spark, target, [n for n in versions(spark, target) if n <= number])

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _by_folder(paths: list[str]) -> dict[str, list[str]]:
    found: dict[str, list[str]] = {}
    for p in paths:
        found.setdefault(p.rsplit("/", 1)[0], []).append(p)
    return found


def _fs(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _write(spark: SparkSession, name: str, text: str) -> None:
    """The whole file or none: written beside and renamed."""
    fs, path = _fs(spark, name)
    draft = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name + ".draft")
    out = fs.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(path, False)
    fs.rename(draft, path)


def _manifest(spark: SparkSession, target: str, number: int) -> dict[str, str]:
    fs, path = _fs(spark, f"{target}/versions/{number}.json")
    stream = fs.open(path)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _sweep(spark: SparkSession, target: str, known: list[int]) -> None:
    """Delete the files that only manifests before the last two name."""
    if len(known) < 3:
        return
    kept = {p for n in known[-2:] for p in _manifest(spark, target, n).values()}
    for n in known[:-2]:
        for p in set(_manifest(spark, target, n).values()) - kept:
            fs, path = _fs(spark, p)
            fs.delete(path, True)
        fs, path = _fs(spark, f"{target}/versions/{n}.json")
        fs.delete(path, False)


def versions(spark: SparkSession, target: str) -> list[int]:
    """Numbers of the manifests, in order."""
    fs, path = _fs(spark, f"{target}/versions")
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def read_states(spark: SparkSession, target: str) -> DataFrame | None:
    """The merged table as of the last manifest; None before the first."""
    known = versions(spark, target)
    parts = [spark.read.option("basePath", folder).parquet(*group) for folder, group in _by_folder(list(_manifest(spark, target, known[-1]).values())).items()] if known else []
    if not parts:
        return None
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.drop("bucket")


def job_states(events: DataFrame, by: str = "user_id") -> DataFrame:
    """The folded state of each job: events, kinds, last time, summed value. Works on batches and on streams in complete or update mode; kinds are few, so their set is exact."""
    return events.groupBy(by).agg(F.count("*").alias("events"), F.size(F.collect_set("event_type")).alias("kinds"), F.max("ts").alias("last"), F.sum("value").alias("total"))


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events a window and kind; rows later than the watermark are dropped on a stream."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "events", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", by: str = "user_id") -> DataFrame:
    """Runs of events of one job with no longer pause than gap."""
    timed = events.withWatermark("ts", gap) if events.isStreaming else events
    return timed.groupBy(by, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")
