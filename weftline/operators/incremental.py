"""Processing only new or changed records, by a high watermark on a monotonic commit sequence.

A step reads the rows in (low, high]: low is the watermark the last committed step left,
high is fixed before the step starts. Its output and its new watermark become visible in one
move, the publication of a manifest, so a step that dies in between leaves neither: nothing is skipped, as the
next one starts from the same low, and nothing is repeated, as output without a manifest is never read.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions.text import canonical_json

#: Runs of a log that one step takes when it works off a backlog. Each stays a window of its own; only the commit is shared.
RUNS_A_STEP = 16
#: Steps after which the state is written as a whole, so that a step needn't read all output before it.
SNAPSHOT = 16


class WatermarkRunner:
    """Runs steps over what is new, with output and watermark committed together.

    The folder (on storage all executors share) holds `data/<attempt>` and at times `state/<attempt>` with the output of each
    attempt, and `commits/<n>.json` naming the attempt and watermark that count. A manifest is published
    by a rename that fails if its number exists, so of two concurrent steps one loses; the file system must
    rename atomically (HDFS and its like; an object store needs a committer of its own). A null or empty input gives a commit with no rows.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        path = self._path(self.folder)
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = path.getFileSystem(conf)
        self._context = self._hadoop.FileContext.getFileContext(path.toUri(), conf)
        self._fs.mkdirs(self._path(f"{self.folder}/commits"))

    def _path(self, name: str):
        return self._hadoop.Path(name)

    def _numbers(self) -> list[int]:
        names = (s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.folder}/commits")))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _read(self, number: int) -> dict:
        stream = self._fs.open(self._path(f"{self.folder}/commits/{number}.json"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, number: int, commit: dict) -> None:
        draft, final = self._path(f"{self.folder}/commits/.{commit['attempt']}"), self._path(f"{self.folder}/commits/{number}.json")
        out = self._fs.create(draft, False)
        out.write(bytearray(canonical_json(commit).encode()))
        out.close()
        never = self.spark.sparkContext._gateway.new_array(self._hadoop.Options.Rename, 1)
        never[0] = self._hadoop.Options.Rename.NONE
        try:
            self._context.rename(draft, final, never)
        except Exception as e:
            raise RuntimeError(f"another step committed number {number}") from e

    def commits(self) -> list[dict]:
        """All commits, oldest first."""
        return [self._read(n) for n in self._numbers()]

    def watermark(self):
        """The place in the sequence up to which rows are done; None before the first commit."""
        done = self._numbers()
        return self._value(self._read(done[-1])["high"]) if done else None

    @staticmethod
    def _value(high):
        return dt.datetime.fromtimestamp(high["micros"] // 1_000_000, dt.UTC).replace(tzinfo=None, microsecond=high["micros"] % 1_000_000) if isinstance(high, dict) else high

    @staticmethod
    def _stored(high):
        return {"micros": int((high.replace(tzinfo=dt.UTC) - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)) / dt.timedelta(microseconds=1))} if isinstance(high, dt.datetime) else high

    @staticmethod
    def _bound(value) -> Column:
        """A literal for a place in the sequence; times are naive and in UTC."""
        return F.timestamp_micros(F.lit(WatermarkRunner._stored(value)["micros"])) if isinstance(value, dt.datetime) else F.lit(value)

    def run(self, rows: DataFrame, sequence: str, step: Callable[[DataFrame, DataFrame | None], DataFrame], high=None, reduce: Callable[[DataFrame], DataFrame] | None = None) -> dict | None:
        """Process the rows in (watermark, high] and commit; None if nothing lies above the watermark.

        high is the last place in the sequence when the step starts, unless given. step gets the new rows and the committed
        state: all output so far or, if `reduce` is given, what it leaves of it (None before the first commit). reduce may be applied to what it left, again.
        """
        numbers = self._numbers()
        low = self._value(self._read(numbers[-1])["high"]) if numbers else None
        if high is None:
            timed = rows.schema[sequence].dataType.typeName() == "timestamp"
            high = rows.agg(F.max(F.unix_micros(sequence) if timed else sequence)).first()[0]
            high = self._value({"micros": high}) if timed and high is not None else high
        if high is None or (low is not None and high <= low):
            return None
        fresh = rows.filter(F.col(sequence) <= self._bound(high))
        if low is not None:
            fresh = fresh.filter(F.col(sequence) > self._bound(low))
        attempt = uuid.uuid4().hex
        step(fresh, self._state(reduce)).write.mode("error").parquet(f"{self.folder}/data/{attempt}")
        commit = {"attempt": attempt, "low": self._stored(low), "high": self._stored(high)}
        number = numbers[-1] + 1 if numbers else 0
        if reduce and number % SNAPSHOT == SNAPSHOT - 1:
            before, own = self._state(reduce), reduce(self.spark.read.parquet(f"{self.folder}/data/{attempt}"))
            (own if before is None else reduce(before.unionByName(own))).write.mode("error").parquet(f"{self.folder}/state/{attempt}")
            commit["state"] = attempt
        self._publish(number, commit)
        return commit

    def _state(self, reduce: Callable[[DataFrame], DataFrame] | None) -> DataFrame | None:
        done = self.commits()
        if not done:
            return None
        if reduce is None:
            return self.output()
        first = max((k for k, c in enumerate(done) if c.get("state")), default=-1)
        whole = [self.spark.read.parquet(f"{self.folder}/state/{done[first]['state']}")] if first >= 0 else []
        since = [f"{self.folder}/data/{c['attempt']}" for c in done[first + 1 :]]
        parts = whole + ([reduce(self.spark.read.parquet(*since))] if since else [])
        return parts[0] if len(parts) == 1 else reduce(parts[0].unionByName(parts[1]))

    def output(self) -> DataFrame | None:
        """All committed output; None before the first commit."""
        paths = [f"{self.folder}/data/{c['attempt']}" for c in self.commits()]
        return self.spark.read.parquet(*paths) if paths else None


def _bisect(value: Column, bounds: list, lo: int, hi: int) -> Column:
    """The number of the first bound that is not below value, as a CASE of logarithmic depth."""
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(value <= WatermarkRunner._bound(bounds[mid]), _bisect(value, bounds, lo, mid)).otherwise(_bisect(value, bounds, mid + 1, hi))


def latest(rows: DataFrame, key: Sequence[str], order: str, *more: str) -> DataFrame:
    """The row of each key with the highest `order`, reduced map-side; rows with a null key form a key of their own."""
    kept = [c for c in rows.columns if c not in key and c not in more]
    return rows.groupBy(*key, *more).agg(*((F.max(c) if c == order else F.max_by(c, order)).alias(c) for c in kept))


def changed(fresh: DataFrame, state: DataFrame | None, key: Sequence[str], order: str, fields: Sequence[str], window: str) -> DataFrame:
    """The rows of each window that are new or changed: window, order, key and fields.

    `window` numbers the runs in the order of their cutoffs. Of several rows of one key in one window the one with the highest
    `order` stands; it is taken if the key was never taken or any of `fields` differs from the key's last taken
    row, null being a value of its own. As a row that is not taken equals the last taken one, comparing with the key's
    preceding window is the same; in its first window a key is compared with the state, the last taken row of each key.
    Rows with a null key form a key of their own. Repeated rows count once. An empty table gives none.
    The rows of a key are reduced to one a window before the shuffle, so a hot key costs no more than its windows.
    """
    last = latest(fresh.select(*key, order, *fields, window), key, order, window)
    if state is not None:
        # keys are told apart null-safely; only the state of keys that came again is needed
        same = [last[k].eqNullSafe(state[k]) for k in key]
        met = state.join(last.select(*key).distinct(), [state[k].eqNullSafe(last[k]) for k in key], "left_semi") if same else state
        last = last.unionByName(met.select(*key, order, *fields, F.lit(-1).alias(window)))
    w = Window.partitionBy(*key).orderBy(window)
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.lag(f).over(w))
    taken = last.withColumn("_new", F.lag(F.lit(1)).over(w).isNull() | ~same)
    return taken.filter(F.col("_new") & (F.col(window) >= 0)).select(window, order, *key, *fields)


def successful_runs(log: DataFrame, run: str = "run_no", cutoff: str = "cutoff_at", outcome: str = "outcome") -> list[tuple]:
    """(run, cutoff) of each run that ended well, in the order of the cutoffs; lines logged twice count once, and of runs with one cutoff the lowest number. A job's log is small beside its rows, so it is read to the driver."""
    ok = log.filter((F.lower(F.trim(outcome)) == "ok") & F.col(cutoff).isNotNull() & F.col(run).isNotNull())
    rows = ok.groupBy(run).agg(F.max(F.unix_micros(cutoff)).alias("at")).groupBy("at").agg(F.min(run).alias("run")).orderBy("at").collect()
    return [(r["run"], WatermarkRunner._value({"micros": r["at"]})) for r in rows]


def replay(runner: WatermarkRunner, rows: DataFrame, log: DataFrame, key: Sequence[str] = ("path", "seg_id"), order: str = "feed_id", fields: Sequence[str] = ("source_hash", "context_hash", "translated_at"), arrived: str = "arrived_at", runs_a_step: int = RUNS_A_STEP) -> DataFrame:
    """(run_no, order, key, fields): what every successful run of a log took, whatever failed in between, worked off from the runner's watermark.

    Each successful run is the window from the cutoff before it to its own; failed ones committed nothing and are none.
    A step takes `runs_a_step` windows, from the watermark to the last of their cutoffs, compares their rows with the state that the
    steps before it committed, and commits. A replay that dies goes on from its last commit when called again.
    A null arrival belongs to no run; rows after the last run's cutoff are left for later ones.
    """
    runs = successful_runs(log)
    done = runner.watermark()
    left = [r for r in runs if done is None or r[1] > done]
    named = rows.select(*dict.fromkeys([*key, order, *fields, arrived]))
    for at in range(0, len(left), runs_a_step):
        group = left[at : at + runs_a_step]
        numbers, places = F.array(*(F.lit(n).cast("int") for n, _ in group)), F.array(*(WatermarkRunner._bound(c) for _, c in group))

        def step(fresh: DataFrame, state: DataFrame | None, group: list = group, numbers: Column = numbers, places: Column = places) -> DataFrame:
            placed = fresh.withColumn("_w", _bisect(F.col(arrived), [c for _, c in group], 0, len(group) - 1))
            return changed(placed, state, key, order, fields, "_w").select(numbers[F.col("_w")].alias("run_no"), places[F.col("_w")].alias("_at"), order, *key, *fields)

        # a key's last taken row is the one of its latest run
        runner.run(named, arrived, step, high=group[-1][1], reduce=lambda df: latest(df.drop("run_no"), key, "_at"))
    found = runner.output()
    return found.drop("_at") if found is not None else named.select(F.lit(None).cast("int").alias("run_no"), order, *key, *fields).filter("false")
