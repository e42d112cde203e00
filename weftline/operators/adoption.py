"""Accepting saved translations that meet the glossary as it is now."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.glossary import Glossary

#: What begins an issue about a glossary term.
TERM_ISSUES = ("term ", "Term '", "Segment '")


def adopt(states: DataFrame, glossary: Glossary, key: list[str]) -> DataFrame:
    """(key, stale, flagged, adopted, cleared, unmet, snapshot, issues) of each translated state whose snapshot is stale or that carries a glossary issue.

    states: key, source, translation, glossary_snapshot, issues. Where the translation renders every term that the source uses, a stale snapshot is
    brought up to date (adopted) and glossary issues are dropped (cleared); otherwise unmet names the terms and all stays as it is. States without a translation are left out.
    """
    kinds = [f"`{k}` {states.schema[k].dataType.simpleString()}" for k in key]
    columns = [*key, "stale", "flagged", "adopted", "cleared", "unmet", "snapshot", "issues"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.to_dict("records"):
                used, held = glossary.find(r["source"] or ""), dict(r["glossary_snapshot"]) if r["glossary_snapshot"] is not None else {}
                issues = [i for i in (r["issues"] if r["issues"] is not None else []) if i is not None]
                kept = [i for i in issues if not i.startswith(TERM_ISSUES)]
                stale, flagged = any(held.get(t) != v for t, v in used.items()), len(kept) < len(issues)
                if not stale and not flagged:
                    continue
                unmet = [t for t, _ in glossary.unmet(r["source"] or "", r["translation"])]
                good = not unmet
                out.append((*(r[k] for k in key), stale, flagged, good and stale, good and flagged, unmet, used if good and stale else held, kept if good else issues))
            yield pd.DataFrame(out, columns=columns)

    rows = states.filter("translation is not null").select(*key, "source", "translation", "glossary_snapshot", "issues")
    return rows.mapInPandas(run, ", ".join([*kinds, "stale boolean, flagged boolean, adopted boolean, cleared boolean, unmet array<string>, snapshot map<string,string>, issues array<string>"]))


def summary(adopted: DataFrame) -> DataFrame:
    """(what, name, segments): adopted, cleared and stale segments, and for each term how many stay stale for it."""
    left = F.col("stale") & ~F.col("adopted")
    totals = adopted.agg(*(F.count_if(F.col(c) if c != "left" else left).alias(c) for c in ("adopted", "cleared", "left")))
    rows = totals.select(F.explode(F.array(*(F.struct(F.lit(n).alias("what"), F.lit(None).cast("string").alias("name"), F.col(c).alias("segments")) for n, c in (("adopted", "adopted"), ("cleared", "cleared"), ("stale", "left"))))).alias("r")).select("r.*")
    terms = adopted.filter(left).select(F.explode("unmet").alias("name")).groupBy("name").agg(F.count("*").alias("segments")).select(F.lit("stale term").alias("what"), "name", "segments")
    return rows.unionByName(terms)
