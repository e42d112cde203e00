"""How much of a text's word lines is offered, and the gaps between."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]"


def text_lines(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, body): the lines of each text, numbered from 0; null texts have none, an empty text has one empty line."""
    return documents.select(F.col(key), F.posexplode(F.split(F.col(text), "\n")).alias("line", "body"))


def fenced(lines: DataFrame, key: str) -> DataFrame:
    """Add `code`: whether the line stands in a fenced code block or is one of its fences. A window of one text's lines; its sort spills."""
    w = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    fence = F.col("body").rlike(r"^\s{0,3}(```|~~~)")
    return lines.withColumn("_f", fence).withColumn("_n", F.sum(fence.cast("int")).over(w)).withColumn("code", F.col("_f") | (F.col("_n") % 2 == 1)).drop("_f", "_n")


def coverage(lines: DataFrame, key: str, offered: str) -> DataFrame:
    """(key, word_lines, offered_lines, ratio): a word line holds a letter or digit; the ratio is 1 without word lines."""
    word = F.col("body").rlike(WORD)
    found = lines.groupBy(key).agg(F.count_if(word).alias("word_lines"), F.count_if(word & F.col(offered)).alias("offered_lines"))
    return found.withColumn("ratio", F.when(F.col("word_lines") == 0, 1.0).otherwise(F.col("offered_lines") / F.col("word_lines")))


def gaps(lines: DataFrame, key: str, offered: str) -> DataFrame:
    """(key, first_line, last_line, lines): runs of word lines that are not offered; offered lines close a run, other lines don't."""
    word = F.col("body").rlike(WORD)
    w = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    runs = lines.withColumn("_g", F.sum(F.col(offered).cast("int")).over(w)).filter(word & ~F.col(offered))
    return runs.groupBy(key, "_g").agg(F.min("line").alias("first_line"), F.max("line").alias("last_line"), F.count("*").alias("lines")).drop("_g")


def covered_by_spans(lines: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """Add `offered`: whether a span [start, end] (end inclusive) touches the line [at, to]. A range join within one text, cut into blocks of characters so that a long text is no nested loop."""
    block = 4096
    cut = lambda df, a, b: df.withColumn("_b", F.explode(F.sequence(F.floor(F.col(a) / block), F.floor(F.col(b) / block))))
    l, s = cut(lines, "at", "to"), cut(spans.select(F.col(key), "start", "end"), "start", "end")
    hit = l.join(s, [key, "_b"]).filter("start <= to and end >= at").select(key, "line").distinct().withColumn("offered", F.lit(True))
    return lines.join(hit, [key, "line"], "left").withColumn("offered", F.coalesce("offered", F.lit(False)))
