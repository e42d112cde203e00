"""Consensus from several annotators' labels, with the reliability of each, by a spectral method.

Each annotator's votes on an item are centred on its own label frequencies, so that agreement by
chance, or by always giving one label, adds nothing. The leading eigenvector of the annotators'
agreement matrix, each row corrected for the annotator's overlaps with others, gives reliabilities,
negative ones for annotators that turn labels round; votes weighted by reliability give the consensus.
The matrix is never built: a step of the power
iteration sends the votes weighted by the vector to their items and back, so no pair of annotators
is emitted however many vote on one item. The votes are gathered by item once; after that a step is a pass over
the items without a shuffle, and only the vector moves. `calibrated` is a second
consensus: the weight that each annotator's vote has for each label (apart for each order of presentation),
calibrated once against the spectral one.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import checkpoint

#: Labels at most; a vote is one of a few classes.
MOST_LABELS = 64
#: Annotator tables up to so many rows are sent to every executor; larger ones are joined by shuffle.
BROADCAST_ROWS = 20_000
#: Up to so many annotators the votes of an item are one row (an annotator has one entry in it) and the vector is an array on the driver; beyond, both are joined.
GATHERED = 50_000
ROUNDS = 100


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _sum(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


class Consensus:
    """Holds the cut tables of one run: votes, reliabilities and the labels of the items."""

    def __init__(self, ballots: DataFrame) -> None:
        """ballots: item, annotator, context, label, seq. Of several ballots of one annotator on one item in one context the last (highest seq) stands.

        Null items, annotators or labels are dropped; a null context is a context of its own. No ballots give no labels.
        """
        clean = ballots.filter(F.col("item").isNotNull() & F.col("annotator").isNotNull() & F.col("label").isNotNull()).withColumn("context", F.coalesce("context", F.lit("")))
        self.votes = checkpoint(clean.groupBy("item", "annotator", "context").agg(F.max_by("label", "seq").alias("label")))
        counts = {r[0]: r[1] for r in self.votes.groupBy("label").count().orderBy("label").limit(MOST_LABELS + 1).collect()}
        self.labels = list(counts)
        if len(self.labels) > MOST_LABELS:
            raise ValueError(f"more than {MOST_LABELS} labels")
        self.width = range(len(self.labels))
        total = sum(counts.values())
        self.spread = 1.0 - sum(n * n for n in counts.values()) / max(1, total * total)
        self.names: list[str] | None = None
        if self.labels:
            share = [F.avg(F.when(F.col("label") == F.lit(v), 1.0).otherwise(0.0)).alias(f"w{k}") for k, v in enumerate(self.labels)]
            self.folded = checkpoint(self.votes.groupBy("item", "annotator").agg(F.count("*").alias("n"), *share))
            self.own = checkpoint(self.folded.groupBy("annotator").agg(*(F.avg(f"w{k}").alias(f"p{k}") for k in self.width)))
            few = self.own.orderBy("annotator").limit(GATHERED + 1).collect()
            self.annotators = len(few) if len(few) <= GATHERED else self.own.count()
            if len(few) <= GATHERED:
                self._gather(few)

    def _gather(self, own: list) -> None:
        """One row an item with the places of its annotators and their votes."""
        self.names = [r["annotator"] for r in own]
        self.means = np.array([[r[f"p{k}"] for k in self.width] for r in own])
        places = self.folded.sparkSession.createDataFrame(list(enumerate(self.names)), f"a int, annotator {self.folded.schema['annotator'].dataType.simpleString()}")
        entry = F.struct(F.col("a"), *(F.col(f"w{k}") for k in self.width))
        self.items = checkpoint(self.folded.join(F.broadcast(places), "annotator").groupBy("item").agg(F.collect_list(entry).alias("held")))

    @cached_property
    def centred(self) -> DataFrame:
        """One row an item and annotator with its centred vote, and how many others voted on the item; for more annotators than are gathered."""
        centred = checkpoint(self.folded.join(_small(self.own, self.annotators), "annotator").select("item", "annotator", *((F.col(f"w{k}") - F.col(f"p{k}")).alias(f"x{k}") for k in self.width)))
        # sums by item are joined back, not windowed: a hot item is reduced map-side and its join can be split
        return checkpoint(centred.join(centred.groupBy("item").agg((F.count("*") - 1).alias("others")), "item"))

    def _over_items(self, vector: np.ndarray, step, schema: str) -> DataFrame:
        """Run step(items, first places, annotators, centred votes, sums by item) on every batch of items, the sums weighted with the vector."""
        shared, names = self.items.sparkSession.sparkContext.broadcast((vector, self.means)), [f"w{k}" for k in self.width]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            v, means = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                held = batch.column(1)
                entries, edges = held.flatten(), np.asarray(held.offsets)
                a = np.asarray(entries.field("a"))
                x = np.stack([np.asarray(entries.field(n)) for n in names], 1) - means[a]
                first = edges[:-1] - edges[0]
                sums = np.add.reduceat(x * v[a][:, None], first)
                yield step(batch.column(0), first, a, x, sums)

        return self.items.mapInArrow(run, schema)

    def _push(self, vector: DataFrame) -> DataFrame:
        """One step of the power iteration: each annotator's mean agreement beyond chance with the vector-weighted others."""
        held = self.centred.join(_small(vector, self.annotators), "annotator")
        sums = held.groupBy("item").agg(*(F.sum(F.col("v") * F.col(f"x{k}")).alias(f"s{k}") for k in self.width))
        held = held.join(sums, "item")
        beyond = _sum([F.col(f"x{k}") * (F.col(f"s{k}") - F.col("v") * F.col(f"x{k}")) for k in self.width]) if self.labels else F.lit(0.0)
        return held.groupBy("annotator").agg((F.sum(beyond) / F.greatest(F.sum("others"), F.lit(1))).alias("y"))

    def _pushed(self, vector: np.ndarray) -> np.ndarray:
        """The same step over the gathered items."""
        size = len(vector)

        def step(items: pa.Array, first: np.ndarray, a: np.ndarray, x: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
            each = np.diff(np.r_[first, len(a)])
            beyond = (x * (np.repeat(sums, each, 0) - x * vector[a][:, None])).sum(1)
            y, others = np.bincount(a, beyond, size), np.bincount(a, np.repeat(each - 1, each), size)
            seen = np.unique(a)
            return pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(y[seen]), pa.array(others[seen])], names=["a", "y", "others"])

        found = self._over_items(vector, step, "a int, y double, others double").groupBy("a").agg(F.sum("y").alias("y"), F.sum("others").alias("others")).toPandas()
        out = np.zeros(size)
        out[found["a"]] = found["y"] / np.maximum(1, found["others"])
        return out

    def reliabilities(self, rounds: int = ROUNDS) -> DataFrame:
        """(annotator, v): the leading eigenvector, scaled so that the product of two entries is about the annotators' mean agreement beyond chance.

        Warns if the eigenvalue has not settled after `rounds` steps.
        """
        if self.names is None:
            return self._joined_reliabilities(rounds)
        vector, value, norm = np.full(len(self.names), 1.0 / math.sqrt(len(self.names))), 0.0, 0.0
        for _ in range(rounds):
            pushed = self._pushed(vector)
            norm = float(np.linalg.norm(pushed))
            if norm == 0.0:
                break
            vector = pushed / norm
            if abs(norm - value) < 1e-4 * norm:
                break
            value = norm
        else:
            warnings.warn(f"the power iteration has not settled after {rounds} steps", stacklevel=2)
        # most annotators are better than chance: the sign for which the entries add up to more than 0
        scale = self._scale(norm, float((vector**4).sum()), float(vector.sum()))
        return self.own.sparkSession.createDataFrame([(n, float(v)) for n, v in zip(self.names, vector * scale)], f"annotator {self.own.schema['annotator'].dataType.simpleString()}, v double")

    def _scale(self, norm: float, fourth: float, total: float) -> float:
        scale = math.sqrt(norm * max(1, self.annotators - 1) / max(1e-9, 1 - min(0.999, fourth))) if self.annotators and norm > 0 else 0.0
        return scale if total >= 0 else -scale

    def _joined_reliabilities(self, rounds: int) -> DataFrame:
        vector = self.own.select("annotator", F.lit(1.0 / math.sqrt(max(1, self.annotators))).alias("v"))
        value = norm = 0.0
        for _ in range(rounds):
            pushed = checkpoint(self._push(vector))
            norm = math.sqrt(pushed.agg(F.sum(F.col("y") * F.col("y"))).first()[0] or 0.0)
            if norm == 0.0:
                break
            vector = pushed.select("annotator", (F.col("y") / F.lit(norm)).alias("v"))
            if abs(norm - value) < 1e-4 * norm:
                break
            value = norm
        else:
            warnings.warn(f"the power iteration has not settled after {rounds} steps", stacklevel=2)
        fourth, total = vector.agg(F.sum(F.pow("v", F.lit(4))), F.sum("v")).first()
        return checkpoint(vector.select("annotator", (F.col("v") * F.lit(self._scale(norm, fourth or 0.0, total or 0.0))).alias("v")))

    def weights(self, reliability: DataFrame) -> DataFrame:
        """(annotator, reliability, v): reliability is scaled to 1 for an annotator that always gives the true label; v is the weight of its vote."""
        r = F.greatest(F.lit(-0.98), F.least(F.lit(0.98), F.col("v") / math.sqrt(max(self.spread, 1e-9))))
        return reliability.select("annotator", r.alias("reliability"), (r / (1 - r * r)).alias("v"))

    def _argmax(self, scored: DataFrame) -> DataFrame:
        """The label of the highest score; of equal ones the first in the order of labels."""
        best = F.greatest(*(F.col(f"s{k}") for k in self.width)) if len(self.labels) > 1 else F.col("s0")
        label = reduce(lambda rest, k: F.when(F.col(f"s{k}") == best, F.lit(self.labels[k])).otherwise(rest), reversed(self.width), F.lit(None))
        return scored.select("item", label.alias("label"))

    def spectral(self, weights: DataFrame) -> DataFrame:
        """(item, label) by votes weighted with their annotators' reliabilities."""
        if self.names is None:
            held = self.centred.join(_small(weights.select("annotator", "v"), self.annotators), "annotator")
            return self._argmax(held.groupBy("item").agg(*(F.sum(F.col("v") * F.col(f"x{k}")).alias(f"s{k}") for k in self.width)))
        known = {r["annotator"]: r["v"] for r in weights.collect()}

        def step(items: pa.Array, first: np.ndarray, a: np.ndarray, x: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([items, *(pa.array(np.ascontiguousarray(s)) for s in sums.T)], names=["item", *(f"s{k}" for k in range(sums.shape[1]))])

        kind = self.items.schema["item"].dataType.simpleString()
        return self._argmax(self._over_items(np.array([known[n] for n in self.names]), step, f"item {kind}, " + ", ".join(f"s{k} double" for k in self.width)))

    def calibrated(self, consensus: DataFrame) -> DataFrame:
        """(item, label) by the log likelihood of the votes, as each annotator votes in each context on items of each consensus label."""
        known = self.votes.join(consensus.withColumnRenamed("label", "true"), "item")
        counts = [F.sum(F.when(F.col("true") == F.lit(v), 1.0).otherwise(0.0)).alias(f"c{k}") for k, v in enumerate(self.labels)]
        table = known.groupBy("annotator", "context", "label").agg(*counts)
        per = Window.partitionBy("annotator", "context")
        # labels an annotator never gave have no row, so each sum gets the smoothing of all labels
        odds = table.select("annotator", "context", "label", *(F.log((F.col(f"c{k}") + 0.5) / (F.sum(f"c{k}").over(per) + 0.5 * len(self.labels))).alias(f"l{k}") for k in self.width))
        share = consensus.agg(*(F.avg(F.when(F.col("label") == F.lit(v), 1.0).otherwise(0.0)) for v in self.labels)).first()
        prior = [math.log(max(1e-9, x or 0.0)) for x in share]
        odds = checkpoint(odds)
        held = self.votes.join(_small(odds, odds.count()), ["annotator", "context", "label"])
        return self._argmax(held.groupBy("item").agg(*((F.sum(f"l{k}") + F.lit(prior[k])).alias(f"s{k}") for k in self.width)))

    def run(self) -> tuple[DataFrame, DataFrame]:
        """((item, label), (annotator, reliability, v)), by the spectral method."""
        if not self.labels:
            empty = self.votes.select("item", "label")
            return empty, self.votes.select("annotator", F.lit(0.0).alias("reliability"), F.lit(0.0).alias("v"))
        weights = self.weights(self.reliabilities())
        return self.spectral(weights), weights

    def agreement(self, consensus: DataFrame) -> DataFrame:
        """(item, label, votes, agreement): the share of the item's annotators, each counting once, that gave its consensus label."""
        share = self.votes.join(consensus.withColumnRenamed("label", "true"), "item").groupBy("item", "annotator").agg(F.first("true").alias("label"), F.avg((F.col("label") == F.col("true")).cast("double")).alias("_a"))
        return share.groupBy("item").agg(F.first("label").alias("label"), F.count("*").alias("votes"), F.avg("_a").alias("agreement"))


def judge_ballots(pairs: DataFrame, part: str = "overall") -> DataFrame:
    """The ballots in judge_pairs: an annotator is a judge with its model, in any spelling; failed replies (null verdicts) are none. Verdicts other than baseline, candidate and tie are dropped."""
    name = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    label = F.lower(F.trim(F.col(f"verdicts.{part}")))
    rows = pairs.select(F.col("pick_id").alias("item"), F.concat_ws("/", name("judge"), name("judge_model")).alias("annotator"), F.upper(F.trim("shown_order")).alias("context"), label.alias("label"), F.col("vote_id").alias("seq"))
    return rows.filter(F.col("label").isin("baseline", "candidate", "tie"))
