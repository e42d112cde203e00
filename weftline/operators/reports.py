"""Reports: lines of Markdown from aggregates, and pages for a side-by-side viewer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.sources.scan import publish


def percent(n: Column, d: Column) -> Column:
    """x.x% (n/d), or a dash where nothing was counted."""
    return F.when(F.coalesce(d, F.lit(0)) == 0, "—").otherwise(F.format_string("%.1f%% (%d/%d)", n * 100.0 / d, n, d))


def gate_table(rates: DataFrame) -> DataFrame:
    """(candidate, first, final, line): the cells of each candidate's first and final pass rates and its line of a Markdown table. rates: candidate, variant, rows, passed."""
    cell = lambda v: percent(F.coalesce(F.sum(F.when(F.col("variant") == v, F.col("passed"))), F.lit(0)), F.coalesce(F.sum(F.when(F.col("variant") == v, F.col("rows"))), F.lit(0)))
    cells = rates.groupBy("candidate").agg(cell("first").alias("first"), cell("final").alias("final"))
    return cells.withColumn("line", F.concat(F.lit("| "), F.concat_ws(" | ", F.coalesce("candidate", F.lit("")), "first", "final"), F.lit(" |")))


def write_report(lines: DataFrame, order: str, head: list[str], target: str) -> None:
    """A Markdown file under `target`: the head lines, then the lines in the order of a column. A report has a line a candidate, so one part holds it."""
    spark = lines.sparkSession
    first = spark.createDataFrame([(0, f"{k:04d}", t) for k, t in enumerate(head)], "part int, o string, value string")
    rest = lines.select(F.lit(1).alias("part"), F.col(order).cast("string").alias("o"), F.col("line").alias("value"))
    publish(first.unionByName(rest).coalesce(1).sortWithinPartitions("part", "o").select("value"), target, "text")


def viewer_pages(items: DataFrame, outputs: DataFrame) -> DataFrame:
    """(item, page): for each item one JSON page with its blocks and, side by side, every candidate's final texts of the first repeat; of outputs written twice the last counts."""
    last = outputs.filter("repeat_no = 0").groupBy("item", "candidate").agg(F.max_by("finals", "out_id").alias("finals"))
    texts = F.transform_values("finals", lambda k, f: f["translation"])
    sides = last.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("candidate", F.map_entries(texts).alias("texts")))).alias("sides"))
    blocks = F.transform("blocks", lambda b: F.struct(b["id"].alias("id"), b["raw"].alias("raw"), F.transform(b["segments"], lambda s: F.struct(s["index"].alias("index"), s["source"].alias("source"))).alias("segments")))
    page = F.to_json(F.struct("item", "kind", "project", blocks.alias("blocks"), F.coalesce("sides", F.array()).alias("sides")))
    return items.join(sides, "item", "left").select("item", page.alias("page"))


_HTML = """<!doctype html><meta charset="utf-8"><title>Side by side</title><style>td{vertical-align:top;padding:.4em;border:1px solid #ccc}</style><div id="pages"></div>
<script type="application/json" id="data">[%s]</script>
<script>
for (const p of JSON.parse(document.getElementById("data").textContent)) {
  const t = document.createElement("table");
  for (const b of p.blocks) for (const s of b.segments) {
    const r = t.insertRow();
    r.insertCell().textContent = s.source;
    for (const c of p.sides) { const e = (c.texts || []).find(x => x.key === s.index); r.insertCell().textContent = e ? e.value : ""; }
  }
  document.getElementById("pages").append(t);
}
</script>"""


def html_pages(pages: DataFrame) -> DataFrame:
    """(item, html): a page of its own for each item; what could end the script is escaped."""
    head, tail = _HTML.split("%s")
    return pages.select("item", F.concat(F.lit(head), F.replace("page", F.lit("</"), F.lit("<\\/")), F.lit(tail)).alias("html"))
