import datetime as dt

import random

import pytest

from weftline.operators import incremental
from weftline.operators.incremental import WatermarkRunner, replay

T0 = dt.datetime(2026, 3, 1)
ROWS = "feed_id bigint, path string, seg_id string, source_hash bigint, context_hash bigint, translated_at timestamp, arrived_at timestamp, run_no string"
LOG = "run_no int, cutoff_at timestamp, outcome string"


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def brute(rows, log):
    ok = sorted({(r[1], r[0]) for r in log if r[2] == "ok"})
    low, case, found = None, {}, set()
    for cutoff, run in ok:
        seen = {}
        for r in rows:
            if r[6] is not None and r[6] <= cutoff and (low is None or r[6] > low):
                key = (r[1], r[2])
                if key not in seen or seen[key][0] < r[0]:
                    seen[key] = r
        for key, r in seen.items():
            if key not in case or case[key] != r[3:6]:
                found.add((run, r[0]))
                case[key] = r[3:6]
        low = cutoff
    return found


def some_rows(seed, n=300):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["a", "b", None]), f"s{rng.randrange(4)}", rng.choice([1, 2, None]), rng.choice([7, None]), rng.choice([None, at(0), at(1)]), at(rng.randrange(100)) if rng.random() < 0.95 else None, "clash") for i in range(n)]
    log = [(n, at(n * 9), rng.choice(["ok", "ok", "failed", "killed", None])) for n in range(1, 11)]
    return rows, log + log[:3]


def taken(df):
    return {(r.run_no, r.feed_id) for r in df.collect()}


@pytest.mark.parametrize("runs_a_step", [1, 3, 100])
def test_replay_equals_brute_force(spark, tmp_path, monkeypatch, runs_a_step):
    monkeypatch.setattr(incremental, "SNAPSHOT", 2)
    rows, log = some_rows(5)
    runner = WatermarkRunner(spark, f"file://{tmp_path}/job")
    got = replay(runner, spark.createDataFrame(rows, ROWS), spark.createDataFrame(log, LOG), runs_a_step=runs_a_step)
    assert taken(got) == brute(rows, log)
    oks = len({r[0] for r in log if r[2] == "ok"})
    assert len(runner.commits()) == -(-oks // runs_a_step)


def test_replay_survives_failures_anywhere(spark, tmp_path, monkeypatch):
    """Every step dies once with its output written and not committed; then the job is begun anew."""
    rows, log = some_rows(6)
    folder, table, runs = f"file://{tmp_path}/job", spark.createDataFrame(rows, ROWS), spark.createDataFrame(log, LOG)
    publish, calls = WatermarkRunner._publish, []

    def failing(self, number, commit):
        calls.append(number)
        if len(calls) % 2:
            raise OSError("lost before the commit")
        publish(self, number, commit)

    monkeypatch.setattr(WatermarkRunner, "_publish", failing)
    for _ in range(40):
        try:
            got = replay(WatermarkRunner(spark, folder), table, runs, runs_a_step=2)
            break
        except OSError:
            assert len(WatermarkRunner(spark, folder).commits()) == len(calls) // 2
    assert taken(got) == brute(rows, log) and len(calls) > 3
    # nothing is left to do, and what was done stays
    assert taken(replay(WatermarkRunner(spark, folder), table, runs)) == brute(rows, log)


def test_rows_arriving_later_are_taken_by_later_runs_only(spark, tmp_path):
    rows, log = some_rows(8)
    folder = f"file://{tmp_path}/job"
    first = [r for r in log if r[0] <= 5]
    replay(WatermarkRunner(spark, folder), spark.createDataFrame([r for r in rows if r[6] and r[6] <= at(45)], ROWS), spark.createDataFrame(first, LOG))
    got = replay(WatermarkRunner(spark, folder), spark.createDataFrame(rows, ROWS), spark.createDataFrame(log, LOG))
    assert taken(got) == brute(rows, log)


def test_runs_are_ordered_by_cutoff_not_by_number(spark, tmp_path):
    rows = [(1, "a", "s", 1, 1, None, at(1), ""), (2, "a", "s", 1, 1, None, at(11), ""), (3, "a", "s", 2, 1, None, at(21), "")]
    log = [(9, at(5), "ok"), (3, at(15), "ok"), (5, at(25), "OK ")]
    got = replay(WatermarkRunner(spark, f"file://{tmp_path}/job"), spark.createDataFrame(rows, ROWS), spark.createDataFrame(log, LOG))
    assert taken(got) == {(9, 1), (5, 3)}


def test_empty_tables(spark, tmp_path):
    job = lambda n: WatermarkRunner(spark, f"file://{tmp_path}/{n}")
    assert replay(job(1), spark.createDataFrame([], ROWS), spark.createDataFrame([(1, at(1), "ok")], LOG)).count() == 0
    assert replay(job(2), spark.createDataFrame([(1, "a", "s", 1, 1, None, at(1), "")], ROWS), spark.createDataFrame([], LOG)).count() == 0


def test_runner_neither_skips_nor_repeats(spark, tmp_path, monkeypatch):
    runner = WatermarkRunner(spark, f"file://{tmp_path}/job")
    rows = lambda n: spark.range(1, n + 1).withColumnRenamed("id", "feed_id")
    same = lambda df, state: df
    assert runner.watermark() is None and runner.output() is None
    runner.run(rows(3), "feed_id", same)
    with monkeypatch.context() as m:
        m.setattr(runner, "_publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            runner.run(rows(7), "feed_id", same)
    assert runner.watermark() == 3
    assert runner.run(rows(7), "feed_id", same)["low"] == 3
    assert runner.run(rows(7), "feed_id", same) is None
    assert sorted(r[0] for r in runner.output().collect()) == [1, 2, 3, 4, 5, 6, 7]
    times = spark.createDataFrame([(1, at(3)), (2, None)], "feed_id bigint, arrived_at timestamp")
    timed = WatermarkRunner(spark, f"file://{tmp_path}/timed")
    timed.run(times, "arrived_at", same)
    assert timed.watermark() == at(3)


def test_of_two_steps_one_commits(spark, tmp_path):
    one, two = (WatermarkRunner(spark, f"file://{tmp_path}/job") for _ in range(2))
    rows = spark.range(1, 4).withColumnRenamed("id", "feed_id")

    def overtaken(df, state):
        if state is None and not two.commits():
            two.run(rows, "feed_id", lambda d, s: d)
        return df

    with pytest.raises(RuntimeError, match="another step"):
        one.run(rows, "feed_id", overtaken)
    assert len(one.commits()) == 1 and one.output().count() == 3
