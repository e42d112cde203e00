"""Statistics over evaluation rows: gates, verdict folding, win rates, agreement, percentiles, samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.columns import wilson
from weftline.functions.udfs import seeded_key


def gate_rates(gates: DataFrame, by: list[str]) -> DataFrame:
    """(by, rows, passed, rate); rows with a null result count as not passed."""
    return gates.groupBy(*by).agg(F.count("*").alias("rows"), F.count_if("passed").alias("passed")).withColumn("rate", F.col("passed") / F.col("rows"))


def failed_checks(gates: DataFrame, by: list[str]) -> DataFrame:
    """(by, check, failed): how often each check of the map failed."""
    return gates.select(*by, F.explode("checks").alias("check", "ok")).filter("not ok").groupBy(*by, "check").agg(F.count("*").alias("failed"))


def verdict(column: Column) -> Column:
    """baseline, candidate or tie in any spelling; null for anything else."""
    v = F.lower(F.trim(column))
    return F.when(v.isin("baseline", "candidate", "tie"), v)


def last_replies(pairs: DataFrame) -> DataFrame:
    """(pick, judge, model, baseline, candidate, shown_order, side): the last valid reply of each judge in each order, retries dropped."""
    valid = pairs.withColumn("side", verdict(F.col("verdicts.overall"))).filter("side is not null and shown_order is not null")
    return valid.groupBy(F.col("pick_id").alias("pick"), "judge", F.col("judge_model").alias("model"), "baseline", "candidate", "shown_order").agg(F.max_by("side", "vote_id").alias("side"))


def fold_orders(replies: DataFrame, single_stands: bool = False) -> DataFrame:
    """One side a pick and judge: both orders agreeing give it, else a tie. A single order is dropped, or stands alone."""
    found = replies.groupBy("pick", "judge", "model", "baseline", "candidate").agg(F.count("*").alias("orders"), F.min("side").alias("a"), F.max("side").alias("b"))
    kept = found if single_stands else found.filter("orders = 2")
    return kept.select("pick", "judge", "model", "baseline", "candidate", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise("tie").alias("side"))


def tally(folded: DataFrame, by: list[str]) -> DataFrame:
    """(by, wins, losses, ties, rate, low, high): the candidate's; the rate and its 95 % interval over decided pairs, null if there are none."""
    found = folded.groupBy(*by).agg(*(F.count_if(F.col("side") == s).alias(n) for s, n in (("candidate", "wins"), ("baseline", "losses"), ("tie", "ties"))))
    decided = F.col("wins") + F.col("losses")
    low, high = wilson(F.col("wins"), decided)
    return found.withColumn("rate", F.try_divide(F.col("wins"), decided)).withColumn("low", low).withColumn("high", high)


#: Judges whose counts of agreement are kept as a table of their own in each task.
MOST_JUDGES = 2000


def agreement(folded: DataFrame) -> DataFrame:
    """(judge_a, judge_b, picks, agreed): how often two judges judged one pick and gave one side, judge_a before judge_b by name.

    The sides of a pick are one row, of at most one entry a judge. A task adds up products of such rows to tables of judges by judges, so no pair of judges is
    emitted for a pick; the tables are summed. More than MOST_JUDGES judges are an error.
    """
    sides = ("baseline", "candidate", "tie")
    place = F.array_position(F.array(*(F.lit(x) for x in sides)), F.col("side")).cast("int")
    entry = F.struct(F.concat_ws("/", "judge", "model").alias("judge"), place.alias("s"))
    held = folded.filter("side is not null").groupBy("pick").agg(F.collect_list(entry).alias("held"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: dict[str, int] = {}
        met = same = np.zeros((0, 0), np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                column = batch.column(0).slice(start, 4096)
                entries = column.flatten()
                coded = entries.field("judge").dictionary_encode()
                local = np.array([at.setdefault(n, len(at)) for n in coded.dictionary.to_pylist()], np.int64)
                if len(at) > MOST_JUDGES:
                    raise ValueError(f"more than {MOST_JUDGES} judges")
                more = len(at) - len(met)
                met, same = np.pad(met, ((0, more), (0, more))), np.pad(same, ((0, more), (0, more)))
                a, s = local[np.asarray(coded.indices)], np.asarray(entries.field("s"))
                row = np.repeat(np.arange(len(column)), np.diff(np.asarray(column.offsets)))
                there = np.zeros((len(column), len(at)), np.float32)
                for k in range(1, len(sides) + 1):
                    own = np.zeros_like(there)
                    own[row[s == k], a[s == k]] = 1
                    same = same + (own.T @ own).astype(np.int64)
                    there += own
                met = met + (there.T @ there).astype(np.int64)
        names = list(at)
        found = [(names[i], names[j], int(met[i, j]), int(same[i, j])) for i, j in zip(*np.nonzero(met)) if names[i] < names[j]]
        columns = list(zip(*found)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["judge_a", "judge_b", "picks", "agreed"])

    counted = held.select("held").mapInArrow(run, "judge_a string, judge_b string, picks bigint, agreed bigint")
    return counted.groupBy("judge_a", "judge_b").agg(F.sum("picks").alias("picks"), F.sum("agreed").alias("agreed"))


def nearest_rank(values: DataFrame, value: str, percents: list[float]) -> DataFrame:
    """(percent, value): the sorted value at index round(p/100 * (n-1)), half away from zero. Found by counts of distinct values, so nothing is sorted in one task unless the values are all distinct; nulls are left out."""
    counted = values.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("c"))
    # running counts over ranges: totals of the ranges first, then inside each range
    parted = counted.repartitionByRange("v").sortWithinPartitions("v").withColumn("_p", F.spark_partition_id())
    from weftline.session import checkpoint

    held = checkpoint(parted)
    totals = {r["_p"]: r["n"] for r in held.groupBy("_p").agg(F.sum("c").alias("n")).collect()}
    before, run = {}, 0
    for p in sorted(totals):
        before[p] = run
        run += totals[p]
    if not run:
        return values.sparkSession.createDataFrame([], f"percent double, value {values.schema[value].dataType.simpleString()}")
    offset = F.create_map(*(F.lit(x) for kv in before.items() for x in kv))[F.col("_p")]
    w = Window.partitionBy("_p").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = held.withColumn("_hi", F.sum("c").over(w) + offset).withColumn("_lo", F.col("_hi") - F.col("c"))
    spark = values.sparkSession
    asked = spark.createDataFrame([(float(p), int(p / 100 * (run - 1) + 0.5)) for p in percents], "percent double, at bigint")
    return ranked.join(F.broadcast(asked), (F.col("at") >= F.col("_lo")) & (F.col("at") < F.col("_hi"))).select("percent", F.col("v").alias("value"))


def first_per_group(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The row of each group that comes first in the ascending order of `order`; reduced map-side, so a large group is no hot one."""
    rest = [c for c in rows.columns if c not in by]
    return rows.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*by, *(F.col("_row")[c].alias(c) for c in rest))


def seeded_subset(rows: DataFrame, seed: int, n: int, *key: str) -> DataFrame:
    """n rows in a reproducible random order (a sampling operator, so the limit is the feature)."""
    return rows.withColumn("_k", seeded_key(seed, *key)).orderBy("_k", *key).limit(n).drop("_k")


def round_robin(rows: DataFrame, group: str, seed: int, key: str, most: int, least: int, target: int) -> DataFrame:
    """A stratified sample, ordered by the unsigned XXH64 of seed and key: at most `most` of each group in seeded order; everyone gets `least`, then rounds go on until `target`. Only the ranked heads of the groups, at most groups * most rows, are ordered over all groups."""
    w = Window.partitionBy(group).orderBy("_k", key)
    pool = rows.withColumn("_k", seeded_key(seed, key)).withColumn("round", F.row_number().over(w) - 1).filter(F.col("round") < most)
    place = pool.withColumn("place", F.row_number().over(Window.orderBy("round", group)))
    return place.filter((F.col("round") < least) | (F.col("place") <= target)).drop("_k")


def capped_sample(rows: DataFrame, seed: int, key: list[str], cap_by: str, cap: int, preferred: Column, first: int, total: int) -> DataFrame:
    """`first` rows of the preferred ones, then any until `total`, at most `cap` of one `cap_by` over both passes, in seeded order."""
    keyed = rows.withColumn("_k", seeded_key(seed, *key)).withColumn("_p", F.coalesce(preferred, F.lit(False)))
    w = Window.partitionBy(cap_by).orderBy(F.desc("_p"), "_k")
    one = keyed.filter("_p").withColumn("_c", F.row_number().over(Window.partitionBy(cap_by).orderBy("_k"))).filter(F.col("_c") <= cap).orderBy("_k").limit(first).drop("_c")
    rest = keyed.join(one.select(*key), key, "left_anti")
    taken = one.groupBy(cap_by).agg(F.count("*").alias("_t"))
    two = rest.join(taken, cap_by, "left").withColumn("_c", F.row_number().over(Window.partitionBy(cap_by).orderBy("_k")) + F.coalesce("_t", F.lit(0))).filter(F.col("_c") <= cap).orderBy("_k").limit(total).drop("_c", "_t")
    ordered = one.withColumn("_o", F.lit(0)).unionByName(two.withColumn("_o", F.lit(1))).orderBy("_o", "_k").limit(total)
    return ordered.drop("_k", "_p", "_o")


def human_pairs(passing: DataFrame, candidates: list[str], seed: int, count: int, special: Column) -> DataFrame:
    """Blocks for human judging: a fifth special ones, the rest others, each in seeded order; each gets one candidate in turn and a side by the parity of a hash of its place. `candidates` is a small list; the count is the size of the sample."""
    keyed = passing.withColumn("_k", seeded_key(f"human:{seed}", "item", "block")).withColumn("_s", F.coalesce(special, F.lit(False)))
    first = keyed.filter("_s").orderBy("_k").limit(count // 5)
    rest = keyed.filter("not _s").orderBy("_k").limit(count)
    place = F.row_number().over(Window.orderBy(F.desc("_s"), "_k")) - 1
    names = F.array(*(F.lit(c) for c in candidates))
    chosen = first.unionByName(rest).withColumn("place", place).filter(F.col("place") < count)
    side = F.pmod(seeded_key(f"side:{seed}", "place"), F.lit(2).cast("decimal(20,0)")) == 0
    return chosen.select("item", "block", "place", F.get(names, F.pmod("place", F.lit(len(candidates)))).alias("candidate"), side.alias("baseline_first"))


def decision(rates: DataFrame, tallies: DataFrame, baseline: str, trusted: float = 0.5) -> DataFrame:
    """(candidate, gates_hold, judges_hold): a candidate's final and first gate rates are at least the baseline's, and the lower bound of its win rate lies above `trusted`."""
    own = rates.filter(F.col("candidate") == baseline).select("variant", F.col("rate").alias("base"))
    gates = rates.join(own, "variant").groupBy("candidate").agg(F.every(F.col("rate") >= F.col("base")).alias("gates_hold"))
    wins = tallies.filter(F.col("baseline") == baseline).select("candidate", (F.col("low") > trusted).alias("judges_hold"))
    return gates.filter(F.col("candidate") != baseline).join(wins, "candidate", "left").na.fill(False, ["judges_hold"])
