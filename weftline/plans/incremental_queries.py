"""Queries of problem 2: only new or changed records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.incremental import WatermarkRunner, replay
from weftline.session import scratch
from weftline.sources.tables import table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """What each successful run of the log took, worked off step by step by a new job in the shared folder."""
    runner = WatermarkRunner(spark, scratch(spark))
    return replay(runner, table(spark, folder, "segment_states"), table(spark, folder, "sync_runs")).select(F.col("run_no").cast("int"), F.col("feed_id").cast("bigint"))


def p2_run_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Rows each successful run took."""
    return p2_found(spark, folder).groupBy("run_no").agg(F.count("*").alias("taken"))


QUERIES = {"p2_found": p2_found, "p2_run_sizes": p2_run_sizes}

_FOUND = """
with runs as (
  select min(run_no) as run_no, cutoff_at, lag(cutoff_at) over (order by cutoff_at) as lo
  from (select distinct run_no, cutoff_at from sync_runs where outcome = 'ok') group by cutoff_at),
seen as (
  select r.run_no, s.* from segment_states s join runs r
  on s.arrived_at <= r.cutoff_at and (r.lo is null or s.arrived_at > r.lo)),
last as (
  select * from seen qualify row_number() over (partition by path, seg_id, run_no order by feed_id desc) = 1),
prev as (
  select *, lag(feed_id) over w as p, lag(source_hash) over w as a, lag(context_hash) over w as b, lag(translated_at) over w as c
  from last window w as (partition by path, seg_id order by run_no))
select run_no, feed_id from prev
where p is null or a is distinct from source_hash or b is distinct from context_hash or c is distinct from translated_at
"""

ORACLE = {
    "p2_found": _FOUND,
    "p2_run_sizes": f"select run_no, count(*) as taken from ({_FOUND}) group by run_no",
}
