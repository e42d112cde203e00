"""Checks of evaluation outputs block by block: what is present, in order, whole, aligned and sound in its markup."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import columns as C
from weftline.functions.text import ALERTS

CHECKS = ("present", "evaluators", "audit", "alignment", "alert-markers", "truncation")


def variants(outputs: DataFrame) -> DataFrame:
    """(out_id, candidate, item, repeat_no, variant, texts): the first replies and the final texts of every output, by segment index; a failed output has an empty map."""
    keys = ("out_id", "candidate", "item", "repeat_no")
    empty = F.create_map().cast("map<int,string>")
    first = outputs.select(*keys, F.lit("first").alias("variant"), F.coalesce(F.col("first_replies").cast("map<int,string>"), empty).alias("texts"))
    final = outputs.select(*keys, F.lit("final").alias("variant"), F.coalesce(F.transform_values("finals", lambda k, f: f["translation"]).cast("map<int,string>"), empty).alias("texts"))
    return first.unionByName(final)


def item_segments(items: DataFrame) -> DataFrame:
    """(item, parser, block, pos, source) of every segment of the items."""
    blocks = items.select("item", "parser", F.explode("blocks").alias("b"))
    return blocks.select("item", "parser", F.col("b.id").alias("block"), F.explode("b.segments").alias("s")).select("item", "parser", "block", F.col("s.index").alias("pos"), F.col("s.source").alias("source"))


def block_checks(outputs: DataFrame, items: DataFrame, least: float) -> DataFrame:
    """(out_id, variant, block, present, markers, whole): the checks that need no scanner, in built-in functions. An absent text fails only `present`."""
    rows = variants(outputs).join(item_segments(items), "item").withColumn("text", F.try_element_at("texts", "pos"))
    wanted = F.filter(C.alert_markers("source"), lambda m: m.isin(*ALERTS))
    markers = F.coalesce(wanted == C.alert_markers("text"), F.lit(True))
    whole = ~F.coalesce(C.truncated("source", "text", least), F.lit(False))
    return rows.groupBy("out_id", "variant", "block").agg(F.every(F.col("text").isNotNull()).alias("present"), F.every(markers).alias("markers"), F.every(whole).alias("whole"))


def block_gates(outputs: DataFrame, items: DataFrame, least: float, target: str = "ko") -> DataFrame:
    """(out_id, candidate, item, repeat_no, variant, block, passed, checks, issues, repaired): all checks of every block.

    The segments of an output are read together, as texts may have changed places among them. A first reply is mended before it is checked, as the
    retry loop would. Items that outputs don't name, and outputs without an item, give no rows.
    """
    segments = item_segments(items).groupBy("item").agg(F.first("parser").alias("parser"), F.sort_array(F.collect_list(F.struct("pos", "block", "source"))).alias("segments"))
    rows = variants(outputs).join(segments, "item")
    keys = ["out_id", "candidate", "item", "repeat_no", "variant"]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.to_dict("records"):
                texts = {int(k): v for k, v in dict(r["texts"]).items()}
                for block, (checks, issues, repaired) in check_item(r["parser"] or "markdown", [(s["pos"], s["block"], s["source"] or "") for s in r["segments"]], texts, least, target, mend=r["variant"] == "first").items():
                    out.append((*(r[k] for k in keys), block, all(checks.values()), checks, issues, repaired))
            yield pd.DataFrame(out, columns=[*keys, "block", "passed", "checks", "issues", "repaired"])

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", block string, passed boolean, checks map<string,boolean>, issues array<string>, repaired boolean"
    return rows.select(*keys, "parser", "segments", "texts").mapInPandas(run, schema)


def check_item(parser: str, segments: list[tuple[int, str, str]], texts: dict[int, str | None], least: float, target: str = "ko", mend: bool = False) -> dict[str, tuple[dict[str, bool], list[str], bool]]:
    """(checks, issues, repaired) by block of one item's segments, (pos, block, source), against their texts."""
    from weftline.functions import formats, quality
    from weftline.functions import text as X
    from weftline.operators.alignment import misaligned

    held = {pos: (quality.repair(parser, source, t) if mend else t) for pos, _, source in segments if (t := texts.get(pos)) is not None}
    moved = misaligned([(source, held.get(pos)) for pos, _, source in segments])
    found: dict[str, tuple[dict[str, bool], list[str], bool]] = {}
    for k, (pos, block, source) in enumerate(segments):
        checks, issues, repaired = found.setdefault(block, (dict.fromkeys(CHECKS, True), [], False))

        def fail(name: str, why: str, checks: dict = checks, issues: list = issues, pos: int = pos) -> None:
            checks[name] = False
            issues.append(f"[{pos}] {why}")

        if pos not in held:
            fail("present", "no usable text")
            continue
        text = held[pos]
        for issue in quality.link_issues(source, text, parser) + quality.parenthesis_issues(source, text) + quality.ending_issues(source, text, target):
            fail("evaluators", issue)
        outcome, _, defects = formats.audit(parser, source, text, quality.construct_issues, quality.repair)
        if outcome != "Sound":
            fail("audit", ("repaired: " if outcome == "Repaired" else "") + ", ".join(defects))
            found[block] = checks, issues, repaired or outcome == "Repaired"
        if k in moved:
            fail("alignment", "anchors of another segment")
        ours, theirs = [m for m in X.alert_markers(source) if m in ALERTS], X.alert_markers(text)
        if ours != theirs:
            fail("alert-markers", f"alert markers {theirs}, not {ours}")
        if why := X.truncation_issue(source, text, least):
            fail("truncation", why)
    return found
