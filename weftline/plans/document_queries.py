"""Queries on parsed documents, aligned sequences, rendering with a provider, and event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import columns as C
from weftline.operators import alignment as A
from weftline.operators import requests as R
from weftline.operators import state as S
from weftline.plans.text_queries import _CELLS
from weftline.session import scratch, spread
from weftline.sources import parsers as P
from weftline.sources.parsers import parse_documents, round_trips
from weftline.sources.tables import table
from weftline.streaming import state as ST


def document_segments(spark: SparkSession, folder: str) -> DataFrame:
    docs = spread(table(spark, folder, "documents", "doc_id", "text", "parser"), "doc_id")
    return parse_documents(docs, "doc_id", "text", F.col("parser"))


def document_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks and segments of each kind by parser."""
    rows = document_segments(spark, folder).join(table(spark, folder, "documents", "doc_id", "parser"), "doc_id")
    return rows.groupBy("parser", "kind").agg(F.count_distinct("doc_id", "section", "block").alias("blocks"), F.count("*").alias("segments"), F.count_distinct("source_hash").alias("distinct_sources"))


def _parsed(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents", "doc_id", "text", "parser"), "doc_id")


def document_tables(spark: SparkSession, folder: str) -> DataFrame:
    return P.document_tables(_parsed(spark, folder), "doc_id", "text", F.col("parser"))


def block_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Tables of raw blocks, by the rules of Markdown."""
    rows = spread(table(spark, folder, "raw_blocks", "raw_id", "source"), "raw_id")
    return P.document_tables(rows, "raw_id", "source", F.lit("markdown"))


def document_constructs(spark: SparkSession, folder: str) -> DataFrame:
    return P.document_constructs(_parsed(spark, folder), "doc_id", "text", F.col("parser"))


def document_rebuilt(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose sentences, put back by their spans, are not all read again as they were."""
    return P.rebuilt(_parsed(spark, folder), "doc_id", "text", F.col("parser")).filter("segments <> kept")


def document_line_maps(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of each document carried to a copy of itself, where each must stay in its place."""
    return P.line_maps(_parsed(spark, folder).withColumn("copy", F.col("text")), "doc_id", "text", "copy", F.col("parser"))


def misaligned_segments(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "segment_states", "path", "seg_id", "feed_id", "source", "translation")
    now = S.latest(rows, ["path", "seg_id"], "feed_id").withColumn("at", C.flat_index("seg_id"))
    return A.misaligned_in_sequence(now, "path", "at", "source", "translation")


def rendered_batches(spark: SparkSession, folder: str) -> DataFrame:
    """The pending segments of each block, rendered by the deterministic provider."""
    rows = table(spark, folder, "segment_states", "path", "seg_id", "feed_id", "source", "translation")
    now = S.latest(rows, ["path", "seg_id"], "feed_id").filter("translation is null")
    block = F.concat_ws("#", "path", C.block_id("seg_id"))
    batches = now.groupBy(block.alias("batch")).agg(F.map_from_entries(F.collect_list(F.struct(C.segment_position("seg_id")["seg"], "source"))).alias("texts"))
    return R.render(batches, R.EchoProvider, lambda source, text: [] if text == source.upper() else ["not in capitals"])


def misaligned_shifted(spark: SparkSession, folder: str) -> DataFrame:
    """The same where every tenth translated segment of a file has got its successor's translation: what the check finds of such a fault."""
    rows = table(spark, folder, "segment_states", "path", "seg_id", "feed_id", "source", "translation")
    now = S.latest(rows, ["path", "seg_id"], "feed_id").filter("translation is not null").withColumn("at", C.flat_index("seg_id"))
    near = S.neighbours(now, "path", "at", "translation")
    moved = near.withColumn("translation", F.when(F.pmod(F.crc32(F.encode("seg_id", "utf-8")), F.lit(10)) == 0, F.coalesce("after_translation", "translation")).otherwise(F.col("translation")))
    return A.misaligned_in_sequence(moved, "path", "at", "source", "translation").withColumn("anchors", F.array_join("anchors", " "))


def stream_latest_segments(spark: SparkSession, folder: str) -> DataFrame:
    """segment_states delivered in four files, read as a stream file by file and merged batch by batch: must equal latest_segments."""
    columns = ["path", "seg_id", "feed_id", "source_hash", "translated_at"]
    source = table(spark, folder, "segment_states", *columns)
    base = scratch(spark)
    source.repartitionByRange(4, "feed_id").write.parquet(f"{base}/feed")
    stream = ST.read_stream(spark, f"{base}/feed", source.schema)
    ST.merge_states(stream, f"{base}/table", f"{base}/log", ["path", "seg_id"], "feed_id").awaitTermination()
    found = ST.read_states(spark, f"{base}/table")
    return found.select(*columns) if found is not None else source.limit(0)


def event_job_states(spark: SparkSession, folder: str) -> DataFrame:
    return ST.job_states(table(spark, folder, "events", "user_id", "ts", "event_type", "value")).withColumn("total", F.round("total", 4))


def document_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each document, taken apart and put together again without translations, and with every sentence in its own words, is itself: byte for byte, and in the words of its blocks."""
    docs = spread(table(spark, folder, "documents", "doc_id", "text", "parser"), "doc_id")
    return round_trips(docs.filter("text is not null"), "doc_id", "text", F.col("parser"))


def event_windows(spark: SparkSession, folder: str) -> DataFrame:
    return ST.windowed_counts(table(spark, folder, "events")).select("start", "event_type", "events", F.round("total", 4).alias("total"))


def event_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return ST.sessions(table(spark, folder, "events", "user_id", "ts")).select("user_id", "start", "events")


QUERIES = {f.__name__: f for f in (document_segments, document_blocks, document_tables, block_tables, document_constructs, document_rebuilt, document_line_maps, misaligned_segments, misaligned_shifted, document_round_trip, rendered_batches, stream_latest_segments, event_job_states, event_windows, event_sessions)}

ORACLE = {
    "block_tables": f"select raw_id, table_no - 1 as table_no, table_row as row_no, \"column\" as column_no, text as cell from {_CELLS}",
    "document_line_maps": "select doc_id, n::int as line, n::int as to_line from (select doc_id, unnest(range(0, length(text) - length(replace(text, chr(10), '')) + 1)) as n from documents where text is not null)",
    "document_rebuilt": "select doc_id, 0::int as segments, 0::int as kept from documents where false",
    "document_round_trip": "select doc_id, true as same, true as spans_hold from documents where text is not null",
    "rendered_batches": "select path || '#' || regexp_replace(seg_id, '/seg:[^/]*$', '') as batch, split_part(split_part(seg_id, '/', 3), ':', 2)::int as pos, upper(source) as translation, 1 as attempts, []::varchar[] as issues from (select * from segment_states qualify row_number() over (partition by path, seg_id order by feed_id desc) = 1) where translation is null",
    "stream_latest_segments": "select path, seg_id, feed_id, source_hash, translated_at from segment_states qualify row_number() over (partition by path, seg_id order by feed_id desc) = 1",
    "event_job_states": "select user_id, count(*) as events, count(distinct event_type) as kinds, max(ts) as last, round(sum(value), 4) as total from events group by user_id",
    "event_windows": "select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as events, round(sum(value), 4) as total from events group by 1, 2",
    "event_sessions": """
with g as (select user_id, ts, case when ts >= lag(ts) over w + interval 30 minutes or lag(ts) over w is null then 1 else 0 end as new from events window w as (partition by user_id order by ts)),
s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as n from g)
select user_id, min(ts) as start, count(*) as events from s group by user_id, n
""",
}
