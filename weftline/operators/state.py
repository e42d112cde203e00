"""Segment states: latest rows, context by neighbours, status, reconciliation of a new parse with saved rows, renames."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.columns import flat_index


def latest(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The row of each key with the highest order. Reduced before the shuffle, so a key delivered again and again is no hot group."""
    rest = [c for c in rows.columns if c not in (*key, order)]
    return rows.groupBy(*key).agg(F.max(order).alias(order), *(F.max_by(c, order).alias(c) for c in rest)).select(*rows.columns)


#: Positions of one section, by flat_index; files are cut there so that a large one is no hot group.
SECTION = 1_000_000


def neighbours(rows: DataFrame, file: str, position: str, value: str, chunk: int = SECTION) -> DataFrame:
    """Add before_ and after_ with the neighbours' value in the file; null at the ends.

    Windows run over chunks of a file's positions; only the ends of the chunks, one row each, are ordered over
    the whole file and joined back to the rows at the edges. Positions are unique in a file; null ones form a chunk of their own.
    """
    before, after = f"before_{value}", f"after_{value}"
    cut = rows.withColumn("_c", F.floor(F.col(position) / F.lit(chunk)))
    w = Window.partitionBy(file, "_c").orderBy(position)
    inside = cut.withColumn(before, F.lag(value).over(w)).withColumn(after, F.lead(value).over(w)).withColumn("_first", F.lag(F.lit(1)).over(w).isNull()).withColumn("_last", F.lead(F.lit(1)).over(w).isNull())
    ends = cut.groupBy(file, "_c").agg(F.min_by(value, position).alias("_head"), F.max_by(value, position).alias("_tail"))
    across = Window.partitionBy(file).orderBy("_c")
    edges = ends.select(F.col(file).alias("_f"), F.col("_c").alias("_k"), F.lag("_tail").over(across).alias("_before"), F.lead("_head").over(across).alias("_after"))
    joined = inside.join(edges, F.col(file).eqNullSafe(F.col("_f")) & F.col("_c").eqNullSafe(F.col("_k")), "left")
    return joined.withColumn(before, F.when(F.col("_first"), F.col("_before")).otherwise(F.col(before))).withColumn(after, F.when(F.col("_last"), F.col("_after")).otherwise(F.col(after))).drop("_c", "_first", "_last", "_f", "_k", "_before", "_after")


def numbered(rows: DataFrame, file: str, order: list[str], name: str) -> DataFrame:
    """Add each row's place in its file, from 0 in the order of `order`, without a task that holds a whole file.

    Rows are cut into ranges of (file, order), so a large file is spread over several; the ranges' counts of each file,
    one row a file and range, are added up and joined back. Rows equal in file and order get places in any order.
    """
    from weftline.session import checkpoint

    ranged = checkpoint(rows.repartitionByRange(file, *order).sortWithinPartitions(file, *order).withColumn("_p", F.spark_partition_id()))
    before = Window.partitionBy("_f").orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy(F.col(file).alias("_f"), F.col("_p").alias("_q")).agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("_p", file).orderBy(*order)) - 1
    joined = ranged.withColumn("_in", inside).join(offsets, F.col(file).eqNullSafe(F.col("_f")) & (F.col("_p") == F.col("_q")))
    return joined.withColumn(name, F.col("_in") + F.col("_before")).drop("_p", "_in", "_f", "_q", "_n", "_before")


def status(translation: Column, saved_hash: Column, current_hash: Column, saved_context: Column, current_context: Column, glossary_stale: Column | None = None) -> Column:
    """One of Pending, Stale, GlossaryStale, ContextChanged, Translated; the first that holds. Null hashes differ from any other."""
    return (
        F.when(translation.isNull(), "Pending")
        .when(~saved_hash.eqNullSafe(current_hash), "Stale")
        .when(F.coalesce(glossary_stale, F.lit(False)) if glossary_stale is not None else F.lit(False), "GlossaryStale")
        .when(~saved_context.eqNullSafe(current_context), "ContextChanged")
        .otherwise("Translated")
    )


def needs_translation(state: Column) -> Column:
    return state != "Translated"


def is_high_priority(state: Column) -> Column:
    return state.isin("Pending", "Stale", "GlossaryStale")


def snapshot_stale(snapshot: Column, used: Column) -> Column:
    """Whether a used term is rendered otherwise than in the snapshot; extra snapshot entries don't matter."""
    return F.size(F.map_filter(used, lambda k, v: ~F.coalesce(F.try_element_at(snapshot, k), F.lit("")).eqNullSafe(v))) > 0


class _Nearest:
    """Places in ascending order of which the nearest free one is taken; taken ones are skipped by links to the next free place on either side."""

    def __init__(self) -> None:
        self.at: list[int] = []
        self.ids: list[str] = []
        self.left: list[int] = [0]
        self.right: list[int] = []

    def add(self, at: int, id_: str) -> None:
        self.at.append(at)
        self.ids.append(id_)
        # places count from 1; 0 and one past the end mean none
        self.left.append(len(self.at))

    @staticmethod
    def _free(links: list[int], k: int) -> int:
        root = k
        while links[root] != root:
            root = links[root]
        while links[k] != root:
            links[k], k = root, links[k]
        return root

    def take(self, at: int) -> str | None:
        """The id at the nearest free place, of two equally near the earlier; None if none is free."""
        n = len(self.at)
        if not self.right:
            self.right = list(range(n + 2))
        k = bisect.bisect_right(self.at, at)
        a, b = self._free(self.left, k), self._free(self.right, k + 1)
        if not a and b > n:
            return None
        best = a if b > n or (a and at - self.at[a - 1] <= self.at[b - 1] - at) else b
        if best == a:
            # of equal places the earliest
            first = bisect.bisect_left(self.at, self.at[a - 1]) + 1
            best = self._free(self.right, first)
        self.left[best], self.right[best] = best - 1, best + 1
        return self.ids[best - 1]


def reconcile(new: DataFrame, saved: DataFrame) -> DataFrame:
    """Match new segments with saved ones of equal hash in their file, one to one and nearest first.

    new: file, id, hash. saved: file, id, hash. Result: file, id, hash, saved_id (null for a new segment).
    New rows choose in document order among the unused saved rows of their hash the nearest one; of two
    equally near the earlier saved row. Hashes found once on both sides are joined; only the others are
    grouped, by file and hash. Within such a group rows arrive sorted: the saved ones are kept as places and ids, of
    one group at a time, and each new one finds the nearest free place in logarithmic time, so a group of many equal segments takes no square of them.
    Rows with a null hash match nothing; ids are unique in a file.
    """
    a = new.select("file", "id", "hash", flat_index("id").alias("at"))
    b = saved.select("file", "id", "hash", flat_index("id").alias("at"))
    count = lambda df, n: df.filter("hash is not null").groupBy("file", "hash").agg(F.count("*").alias(n), F.first("id").alias(f"id_{n}"))
    counts = count(a, "na").join(count(b, "nb"), ["file", "hash"])
    plain = counts.filter("na = 1 and nb = 1").select("file", "hash", F.col("id_nb").alias("saved_id"))
    many = counts.filter("na > 1 or nb > 1").select("file", "hash")
    # one side of each crowded group beside the other, in document order
    sides = a.join(many, ["file", "hash"], "left_semi").withColumn("side", F.lit(1)).unionByName(b.join(many, ["file", "hash"], "left_semi").withColumn("side", F.lit(0)))
    ordered = sides.repartition("file", "hash").sortWithinPartitions("file", "hash", "side", "at", "id")

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, free = None, _Nearest()
        for batch in batches:
            out = []
            for file, id_, hash_, at, side in zip(batch["file"], batch["id"], batch["hash"], batch["at"], batch["side"]):
                if (file, hash_) != group:
                    group, free = (file, hash_), _Nearest()
                if side == 0:
                    free.add(at, id_)
                elif (found := free.take(at)) is not None:
                    out.append((file, hash_, id_, found))
            yield pd.DataFrame(out, columns=["file", "hash", "id", "saved_id"])

    kinds = {c: new.schema[c].dataType.simpleString() for c in ("file", "hash", "id")}
    crowded = ordered.mapInPandas(match, f"file {kinds['file']}, hash {kinds['hash']}, id {kinds['id']}, saved_id string")
    single = a.join(plain, ["file", "hash"]).select("file", "hash", "id", "saved_id")
    matched = single.unionByName(crowded)
    return a.select("file", "id", "hash").join(matched, ["file", "id", "hash"], "left")


def reconcile_counts(new: DataFrame, saved: DataFrame) -> DataFrame:
    """(file, kept, added, dropped) of a reconciliation, without doing it: a hash keeps the smaller number of its rows."""
    count = lambda df, n: df.groupBy("file", "hash").agg(F.count("*").alias(n))
    both = count(new, "a").join(count(saved, "b"), ["file", "hash"], "full").na.fill(0, ["a", "b"])
    return both.groupBy("file").agg(F.sum(F.least("a", "b")).alias("kept"), F.sum(F.greatest(F.col("a") - F.col("b"), F.lit(0))).alias("added"), F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0))).alias("dropped"))


def renamed_files(files: DataFrame, orphans: DataFrame, least: float = 0.5) -> DataFrame:
    """(file, orphan, shared, score): orphaned states that hold at least `least` of a file's distinct hashes.

    files and orphans: name, hash. Only the rarest hashes of a file are joined: a file of n hashes that shares
    ceil(least * n) of them shares one of its rarest n - ceil(least * n) + 1, so hashes in every file are
    no hot keys, and nothing is lost. Candidates are then counted exactly.
    """
    f = files.filter("hash is not null").select(F.col("name").alias("file"), "hash").distinct()
    o = orphans.filter("hash is not null").select(F.col("name").alias("orphan"), "hash").distinct()
    spread = o.groupBy("hash").agg(F.count("*").alias("_n"))
    rare = f.join(spread, "hash", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    # how rare a hash must be is found from counts by rarity, so no task ranks a whole file
    by = rare.groupBy("file", "_n").agg(F.count("*").alias("_c"))
    w = Window.partitionBy("file")
    upto = by.withColumn("_size", F.sum("_c").over(w)).withColumn("_before", F.sum("_c").over(w.orderBy("_n")) - F.col("_c"))
    needed = F.col("_size") - F.ceil(F.lit(least) * F.col("_size")) + 1
    most = upto.filter(F.col("_before") < needed).groupBy("file").agg(F.max("_n").alias("_most"))
    prefix = rare.join(most, "file").filter((F.col("_n") > 0) & (F.col("_n") <= F.col("_most")))
    pairs = prefix.select("file", "hash").join(o, "hash").select("file", "orphan").distinct()
    shared = pairs.join(f, "file").join(o, ["orphan", "hash"]).groupBy("file", "orphan").agg(F.count("*").alias("shared"))
    sizes = f.groupBy("file").agg(F.count("*").alias("_size"))
    return shared.join(sizes, "file").withColumn("score", F.col("shared") / F.col("_size")).filter(F.col("score") >= least).select("file", "orphan", "shared", "score")


#: Rounds of claims at most; each claims one pair at least.
MOST_ROUNDS = 200


def claim_orphans(pairs: DataFrame) -> DataFrame:
    """(file, orphan, score): each file its best orphan and each orphan once, by mutual best choice repeated until none is left; ties go by name. Raises after MOST_ROUNDS."""
    from weftline.session import checkpoint

    left, found = checkpoint(pairs.select("file", "orphan", "score")), None
    for _ in range(MOST_ROUNDS):
        # best by aggregates that are reduced map-side: highest score, then the first name
        of_file = left.groupBy("file").agg(F.min_by("orphan", F.struct(-F.col("score"), F.col("orphan"))).alias("orphan"))
        of_orphan = left.groupBy("orphan").agg(F.min_by("file", F.struct(-F.col("score"), F.col("file"))).alias("file"))
        best = checkpoint(left.join(of_file, ["file", "orphan"], "left_semi").join(of_orphan, ["file", "orphan"], "left_semi"))
        if best.isEmpty():
            return found if found is not None else best
        found = best if found is None else found.unionByName(best)
        left = checkpoint(left.join(best.select("file"), "file", "left_anti").join(best.select("orphan"), "orphan", "left_anti"))
    raise ArithmeticError(f"pairs are left after {MOST_ROUNDS} rounds")


def _greedy(sizes: list[int], counts: list[int], start: int, state: tuple[int, int], limit: int, bytes_limit: int, glue: int, first: bool = False) -> tuple[list[int], tuple[int, int]]:
    """(places before which a batch is closed, or the first of them, the open batch's segments and bytes after the last row) of adjacent groups from place `start` on, begun with an open batch."""
    total, weight = state
    closed = []
    for k in range(start, len(sizes)):
        n, c = sizes[k], counts[k]
        if total and (total + c > limit or weight + glue + n > bytes_limit):
            closed.append(k)
            if first:
                break
            total = weight = 0
        weight += n + (glue if total else 0)
        total += c
    return closed, (total, weight)


def batches(rows: DataFrame, file: str, order: list[str], size: str, limit: int, bytes_limit: int = 16_384, glue: int = 7, segments: str | None = None, chunk: int = 20_000) -> DataFrame:
    """Number the batches of adjacent groups: a batch is closed before the group that would exceed `limit` segments or `bytes_limit` bytes.

    A group larger than a limit stays alone, and limit 1 closes after every group. Adds column `batch`, from 0 in each file. Every group holds a segment at least.
    A file of more than `chunk` groups is cut into chunks, so that it is read by many tasks. A batch that is open where a chunk
    begins is closed within the chunk's first `limit` groups, so each chunk tells for every such place how many batches follow and
    what is left open at its end; going through the chunks of a file by these tables, not by its groups, gives the place where each really begins.
    """
    count = F.greatest(F.lit(1), F.coalesce(F.col(segments) if segments else F.lit(1), F.lit(1)))
    named = rows.withColumn("_size", F.coalesce(F.col(size), F.lit(0)).cast("bigint")).withColumn("_count", count.cast("bigint"))
    large = named.groupBy(F.col(file).alias("_f")).agg(F.count("*").alias("_n")).filter(F.col("_n") > chunk).select("_f")
    names, schema = rows.columns, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", batch int"

    def stream(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, number, total, weight = object(), 0, 0, 0
        for part in parts:
            numbers = []
            for name, n, c in zip(part[file], part["_size"], part["_count"]):
                if name != current:
                    current, number, total, weight = name, 0, 0, 0
                elif total and (total + c > limit or weight + glue + n > bytes_limit):
                    number, total, weight = number + 1, 0, 0
                weight += n + (glue if total else 0)
                total += c
                numbers.append(number)
            part["batch"] = numbers
            yield part[[*names, "batch"]]

    # a file of one chunk is read as a sorted stream
    of_large = F.col(file).eqNullSafe(F.col("_f"))
    streamed = lambda df: df.repartition(file).sortWithinPartitions(file, *order).mapInPandas(stream, schema)
    if large.isEmpty():
        return streamed(named)
    whole = streamed(named.join(large, of_large, "left_anti"))
    placed = numbered(named.join(large, of_large, "left_semi"), file, order, "_i").withColumn("_c", F.floor(F.col("_i") / F.lit(chunk)).cast("bigint"))
    kind = rows.schema[file].dataType.simpleString()

    def tables(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_i")
        sizes, counts = part["_size"].tolist(), part["_count"].tolist()
        known: dict[int, tuple[int, tuple[int, int]]] = {}

        def follow(start: int) -> tuple[int, tuple[int, int]]:
            """Batches closed after one that begins at `start`, and what is left open; every place is gone through once."""
            path = []
            while start not in known:
                closed, left = _greedy(sizes, counts, start, (0, 0), limit, bytes_limit, glue, first=True)
                if not closed:
                    known[start] = 0, left
                    break
                path.append(start)
                start = closed[0]
            n, left = known[start]
            for place in reversed(path):
                n += 1
                known[place] = n, left
            return n, left

        heads = min(len(sizes), limit + 1)
        told = [follow(start) for start in range(heads)]
        columns = {"f": part["f"].iloc[0], "c": part["c"].iloc[0], "sizes": sizes[:heads], "counts": counts[:heads], "closes": [n for n, _ in told], "total": [t for _, (t, _) in told], "weight": [w for _, (_, w) in told]}
        return pd.DataFrame([columns])

    def entries(part: pd.DataFrame) -> pd.DataFrame:
        out, number, state = [], 0, (0, 0)
        for r in part.sort_values("c").to_dict("records"):
            out.append((r["f"], r["c"], number, *state))
            closed, left = _greedy(list(r["sizes"]), list(r["counts"]), 0, state, limit, bytes_limit, glue)
            first = closed[0] if closed else 0 if not state[0] else None
            if first is None:
                # the chunk, a file's last, lies within the open batch
                state = left
            else:
                number, state = number + len(closed[:1]) + int(r["closes"][first]), (int(r["total"][first]), int(r["weight"][first]))
        return pd.DataFrame(out, columns=["f", "c", "number", "total", "weight"])

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, begin = left.sort_values("_i"), right.iloc[0]
        closed, _ = _greedy(left["_size"].tolist(), left["_count"].tolist(), 0, (int(begin["total"]), int(begin["weight"])), limit, bytes_limit, glue)
        marks = np.zeros(len(left), np.int64)
        marks[closed] = 1
        left["batch"] = (int(begin["number"]) + np.cumsum(marks)).astype(np.int32)
        return left[[*names, "batch"]]

    slim = placed.select(F.col(file).alias("f"), F.col("_c").alias("c"), "_i", "_size", "_count")
    told = slim.groupBy("f", "c").applyInPandas(tables, f"f {kind}, c bigint, sizes array<bigint>, counts array<bigint>, closes array<bigint>, total array<bigint>, weight array<bigint>")
    begun = told.groupBy("f").applyInPandas(entries, f"f {kind}, c bigint, number bigint, total bigint, weight bigint")
    return whole.unionByName(placed.groupBy(file, "_c").cogroup(begun.groupBy("f", "c")).applyInPandas(run, schema))
