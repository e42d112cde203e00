"""Texts that lost their end to a field limit or on the way, and how often each source loses it."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.terminal import TerminalModel, common_limits, fit, open_ended

#: Rows of each stratum, up to chance, that a model is fitted on (a documented bound; scoring has none).
SAMPLE = 4000
_TRAILS_OFF = r"(?s)(\.\.\.|…|\[\.\.\.\]|\[…\])\s*$"


_WHOLE = 1 << 32


class Census:
    """What one pass over all texts tells: the common limits of each src, and the size of each stratum."""

    def __init__(self, limits: dict[str, frozenset[int]], sizes: dict[tuple[str, int], int]) -> None:
        self.limits, self.sizes = limits, sizes


def _stratum() -> Column:
    """Sources that trail off, headings, and the rest."""
    return F.when(F.col("source").rlike(_TRAILS_OFF), 1).when(F.col("source").rlike(r"(?s)[\p{L}\p{N}]\s*$"), 2).otherwise(0)


def census(texts: DataFrame) -> Census:
    """Count the texts of each src, stratum and length in one pass; of open-ended texts the distinct ones, told apart by hash. Rows are reduced map-side; what reaches the driver are counts by length."""
    ended = open_ended(F.col("text"))
    per = texts.filter(F.col("text").isNotNull()).select("src", _stratum().alias("s"), F.when(ended, F.length("text")).alias("n"), F.when(ended, F.xxhash64("text")).alias("h"))
    rows = per.groupBy("src", "s", "n", "h").agg(F.count("*").alias("c")).groupBy("src", "s", "n").agg(F.sum("c").alias("c"), F.count("h").alias("texts")).collect()
    counts: dict[str, Counter] = defaultdict(Counter)
    sizes: Counter = Counter()
    for r in rows:
        sizes[r["src"], r["s"]] += r["c"]
        if r["n"] is not None:
            counts[r["src"]][r["n"]] += r["texts"]
    return Census({src: common_limits(c) for src, c in counts.items()}, dict(sizes))


def sample(texts: DataFrame, sizes: dict[tuple[str, int], int], bound: int = SAMPLE) -> dict[str, list[tuple[str | None, str]]]:
    """About `bound` rows of each src and stratum, in one pass: those whose hashed keys lie below the share that gives the bound, so the same on any partitioning. All rows of a stratum no larger."""
    hashed = F.pmod(F.xxhash64("src", "row_id", "pos"), F.lit(_WHOLE))
    kept = F.lit(False)
    for (src, s), n in sizes.items():
        kept = kept | ((F.col("src") == src) & (F.col("_s") == s) & (hashed < F.lit(int(_WHOLE * min(1.0, bound / n)))))
    rows = texts.filter(F.col("text").isNotNull()).withColumn("_s", _stratum()).filter(kept).select("src", "source", "text", hashed.alias("_h")).toPandas() if sizes else None
    found: dict[str, list[tuple[str | None, str]]] = defaultdict(list)
    if rows is not None:
        rows = rows.sort_values(["_h", "text"], kind="stable")
        for src, source, text in zip(rows["src"], rows["source"], rows["text"]):
            found[src].append((source, text))
    return found


def score(texts: DataFrame, models: dict[str, TerminalModel], pick: str = "src") -> DataFrame:
    """Keep texts' columns but source and text, and add the margin of the model that column `pick` names; null for null or blank texts."""
    kept = [c for c in texts.columns if c not in ("source", "text")]
    schema = ", ".join(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in kept) + ", margin float"
    shared = texts.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for whole in batches:
            for at in range(0, max(1, whole.num_rows), 4096):
                batch = whole.slice(at, 4096)
                cols = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
                names, sources, values = (cols[c].to_pylist() for c in (pick, "source", "text"))
                margin: list[float | None] = [None] * len(values)
                for name in set(names):
                    at_ = [i for i, n in enumerate(names) if n == name and values[i] and values[i].strip()]
                    if name in known:
                        for i, m in zip(at_, known[name].margin([(sources[i], values[i]) for i in at_]).tolist()):
                            margin[i] = m
                yield pa.RecordBatch.from_arrays([*(cols[c] for c in kept), pa.array(margin, pa.float32())], names=[*kept, "margin"])

    return texts.select(*kept, "source", "text").mapInArrow(run, schema)


def field_texts(segments: DataFrame, items: DataFrame, outputs: DataFrame, gates: DataFrame) -> DataFrame:
    """(src, row_id, pos, owner, source, text) of every text that may be cut: translations, final translations and issue messages.

    owner is the project of a segment and the candidate of the others. A final translation's source is
    looked up by item and segment index; without one it is judged by its own end alone. Null texts stay, with a null text.
    """
    seg = segments.select(F.lit("segment_states").alias("src"), F.col("feed_id").cast("bigint").alias("row_id"), F.lit(0).alias("pos"), F.expr("try_element_at(split(path, '/'), 2)").alias("owner"), F.coalesce("source", F.lit("")).alias("source"), F.col("translation").alias("text"))
    parts = items.select("item", F.explode("blocks").alias("b")).select("item", F.explode("b.segments").alias("s")).groupBy("item", F.col("s.index").alias("pos")).agg(F.min("s.source").alias("source"))
    finals = outputs.select("out_id", "candidate", "item", F.explode("finals").alias("pos", "f")).select("out_id", "candidate", "item", "pos", F.col("f.translation").alias("text"))
    fin = finals.join(parts, ["item", "pos"], "left").select(F.lit("eval_outputs").alias("src"), F.col("out_id").cast("bigint").alias("row_id"), F.col("pos").cast("int"), F.col("candidate").alias("owner"), F.coalesce("source", F.lit("")).alias("source"), "text")
    msg = gates.select(F.lit("gate_rows").alias("src"), F.col("gate_id").cast("bigint").alias("row_id"), F.col("candidate").alias("owner"), F.posexplode("issues").alias("pos", "text")).select("src", "row_id", "pos", "owner", F.lit(None).cast("string").alias("source"), "text")
    return seg.unionByName(fin).unionByName(msg)


def truncated_texts(texts: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """Score every text: (src, row_id, pos, owner, margin, truncated). One model per src, fitted on about `bound` rows of each of its strata; limits are counted over all.

    The texts are read three times: counted, sampled, scored. Null, empty and blank texts are not truncated. Very long texts are judged by their end and their
    sentence structure. Repeated rows give repeated rows; an empty table gives none.
    """
    known = census(texts)
    rows = sample(texts, known.sizes, bound)
    models = {src: fit(part, limits=known.limits.get(src, frozenset())) for src, part in rows.items()}
    return score(texts, models).withColumn("truncated", F.coalesce(F.col("margin") > 0, F.lit(False)))


def rates(scored: DataFrame) -> DataFrame:
    """How often each owner's texts of each kind are cut."""
    return scored.groupBy("src", "owner").agg(F.count("margin").alias("texts"), F.sum(F.col("truncated").cast("bigint")).alias("cut")).withColumn("rate", F.try_divide("cut", "texts"))
