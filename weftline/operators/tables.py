"""Rules on table cells: grouping cells to tables, header matching, pruning columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.columns import keeps_column, matches_headers
from weftline.sources.scan import glob_regex


def table_groups(cells: DataFrame, by: list[str]) -> DataFrame:
    """(by, headers, columns, rows): one row a table. cells: by, table_row, column, text, label_row. Headers are the texts of the label row in column order; a table without one has an empty array. The array is as long as the header row, which the table's width bounds."""
    label = F.col("label_row")
    pairs = F.sort_array(F.collect_list(F.when(label, F.struct("column", "text"))))
    return cells.groupBy(*by).agg(F.transform(pairs, lambda p: p["text"]).alias("headers"), (F.max("column") + 1).alias("columns"), (F.max("table_row") + 1).alias("rows"))


def apply_rules(cells: DataFrame, by: list[str], rules: list[dict]) -> DataFrame:
    """cells with `offered`: body cells that the first matching rule excludes are not. A rule has headers (a subsequence of the table's), or headerless, and translate or skip (names or 0-based numbers). Rules only ever narrow what is offered; a null header is unnamed."""
    headers = table_groups(cells, by).select(*by, "headers")
    joined = cells.join(headers, by, "left")
    name = F.get(F.col("headers"), F.col("column"))
    keep: Column = F.lit(True)
    for rule in reversed(rules):
        hit = F.size("headers") == 0 if rule.get("headerless") else matches_headers(rule.get("headers", []), "headers")
        keep = F.when(hit, keeps_column(F.col("column"), name, rule.get("translate", []), rule.get("skip", []))).otherwise(keep)
    offered = F.coalesce(F.col("offered"), F.lit(True)) if "offered" in cells.columns else F.lit(True)
    return joined.withColumn("offered", offered & (F.col("label_row") | keep)).drop("headers")


def rule_applies(rule: dict, path: Column) -> Column:
    """Whether a rule's `files` glob takes a path, as a whole or by its last name; a rule without one takes every file."""
    glob = rule.get("files")
    if not glob:
        return F.lit(True)
    regex = glob_regex(glob)
    return path.rlike(regex) | F.regexp_extract(path, r"([^/]*)$", 1).rlike(regex)


def apply_file_rules(cells: DataFrame, by: list[str], path: str, rules: list[dict]) -> DataFrame:
    """apply_rules with rules that name files: to each table the rules apply that take its file, in their order."""
    headers = table_groups(cells, by).select(*by, "headers")
    joined = cells.join(headers, by, "left")
    name = F.get(F.col("headers"), F.col("column"))
    keep: Column = F.lit(True)
    for rule in reversed(rules):
        hit = F.size("headers") == 0 if rule.get("headerless") else matches_headers(rule.get("headers", []), "headers")
        keep = F.when(hit & rule_applies(rule, F.col(path)), keeps_column(F.col("column"), name, rule.get("translate", []), rule.get("skip", []))).otherwise(keep)
    offered = F.coalesce(F.col("offered"), F.lit(True)) if "offered" in cells.columns else F.lit(True)
    return joined.withColumn("offered", offered & (F.col("label_row") | keep)).drop("headers")


def table_profile(cells: DataFrame, by: list[str], samples: int = 3) -> DataFrame:
    """(by, column, cells, excluded, samples): how many cells of each column are offered, and its first texts (a report, so the limit is the feature)."""
    body = cells.filter(~F.col("label_row"))
    first = F.slice(F.sort_array(F.collect_list(F.when(F.col("table_row") <= samples, F.struct("table_row", "text")))), 1, samples)
    return body.groupBy(*by, "column").agg(F.count("*").alias("cells"), F.count_if(~F.col("offered")).alias("excluded"), F.transform(first, lambda p: p["text"]).alias("samples"))


def pipe_tables(blocks: DataFrame, key: str, text: str) -> DataFrame:
    """(key, table_no, table_row, column, text, label_row) of the pipe tables in texts, by built-in functions: a table is a run of lines that begin with a bar, its second line the rule."""
    from pyspark.sql import Window

    lines = blocks.select(F.col(key), F.posexplode(F.split(F.col(text), "\n")).alias("line", "body"))
    bar = F.col("body").rlike(r"^\s*\|")
    w = Window.partitionBy(key).orderBy("line")
    runs = lines.withColumn("_t", bar).withColumn("table_no", F.sum((bar & ~F.coalesce(F.lag(bar).over(w), F.lit(False))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("_t")
    rule = F.col("body").rlike(r"^\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$")
    inner = Window.partitionBy(key, "table_no").orderBy("line")
    kept = runs.filter(~rule).withColumn("table_row", F.row_number().over(inner) - 1)
    cell = F.split(F.regexp_replace(F.regexp_replace("body", r"^\s*\|", ""), r"\|\s*$", ""), r"\|")
    return kept.select(key, "table_no", "table_row", F.posexplode(cell).alias("column", "text")).withColumn("text", F.trim("text")).withColumn("label_row", F.col("table_row") == 0)
