import math
import random

from pyspark.sql import functions as F

from weftline.operators import coverage as V
from weftline.operators import evaluation as E
from weftline.operators import state as S
from weftline.operators import terms as M


def seg(k):
    return f"section:0/block:0/seg:{k}"


def greedy(new, old):
    out, free = {}, {}
    for f, i, h in sorted(old, key=lambda r: int(r[1].rsplit(":", 1)[1])):
        free.setdefault((f, h), []).append(i)
    for f, i, h in sorted(new, key=lambda r: int(r[1].rsplit(":", 1)[1])):
        have = free.get((f, h), []) if h is not None else []
        at = lambda x: int(x.rsplit(":", 1)[1])
        if have:
            best = min(range(len(have)), key=lambda k: (abs(at(have[k]) - at(i)), k))
            out[f, i] = have.pop(best)
        else:
            out[f, i] = None
    return out


def test_reconcile_is_nearest_and_one_to_one(spark):
    rng = random.Random(3)
    new = [("f", seg(5), 1), ("f", seg(6), 1)] + [("g", seg(k), rng.choice([1, 2, 3, None])) for k in range(30)]
    old = [("f", seg(1), 1), ("f", seg(6), 1)] + [("g", seg(k), rng.choice([1, 2, 3, None])) for k in range(25)]
    frame = lambda rows: spark.createDataFrame(rows, "file string, id string, hash bigint")
    got = {(r.file, r.id): r.saved_id for r in S.reconcile(frame(new), frame(old)).collect()}
    assert got == greedy(new, old)
    assert got["f", seg(5)] == seg(6) and got["f", seg(6)] == seg(1)
    counts = S.reconcile_counts(frame(new), frame(old)).filter("file = 'f'").first()
    assert (counts.kept, counts.added, counts.dropped) == (2, 0, 0)
    assert S.reconcile(frame([]), frame(old)).count() == 0


def test_batches_stream_each_file(spark):
    rows = [("a", k, 6000, 1) for k in range(6)] + [("b", 0, 99999, 50), ("b", 1, 1, 1)]
    df = spark.createDataFrame(rows, "path string, at int, bytes bigint, n int")
    got = {(r.path, r.at): r.batch for r in S.batches(df, "path", ["at"], "bytes", 20, segments="n").collect()}
    assert [got["a", k] for k in range(6)] == [0, 0, 1, 1, 2, 2] and [got["b", k] for k in range(2)] == [0, 1]
    one = S.batches(df, "path", ["at"], "bytes", 1, segments="n").filter("path = 'a'")
    assert one.select("batch").distinct().count() == 6


def test_a_crowded_hash_is_matched_in_time(spark):
    import time

    n = 100_000
    frame = lambda step, shift: spark.range(n).selectExpr("'f' as file", f"concat('section:', id div 1000, '/block:', (id * {step} + {shift}) % 1000, '/seg:0') as id", "7L as hash").distinct()
    began = time.time()
    got = S.reconcile(frame(1, 0), frame(1, 1))
    assert got.filter("saved_id is not null").count() == n and time.time() - began < 60


def test_batches_of_a_large_file_are_the_same_in_chunks(spark):
    rng = random.Random(12)
    rows = [(f, k, rng.choice([10, 500, 5000, 20000]), rng.choice([1, 1, 2, 30])) for f, n in (("a", 400), ("b", 7), ("c", 1)) for k in range(n)]
    df = spark.createDataFrame(rows, "path string, at int, bytes bigint, n int")
    want = {}
    for f in "abc":
        number = total = weight = 0
        for _, k, size, c in sorted(r for r in rows if r[0] == f):
            if total and (total + c > 20 or weight + 7 + size > 16384):
                number, total, weight = number + 1, 0, 0
            weight += size + (7 if total else 0)
            total += c
            want[f, k] = number
    for chunk in (1, 3, 30, 20_000):
        got = {(r.path, r.at): r.batch for r in S.batches(df, "path", ["at"], "bytes", 20, segments="n", chunk=chunk).collect()}
        assert got == want, chunk
    assert S.batches(df.limit(0), "path", ["at"], "bytes", 20, segments="n").count() == 0


def test_places_are_numbered_across_ranges(spark):
    df = spark.createDataFrame([("a", k * 3) for k in range(500)] + [("b", 1), (None, 4), (None, 2)], "f string, at int").repartition(5)
    got = {(r.f, r.at): r.i for r in S.numbered(df, "f", ["at"], "i").collect()}
    assert all(got["a", k * 3] == k for k in range(500)) and got["b", 1] == 0 and (got[None, 2], got[None, 4]) == (0, 1)


def test_moved_translations_are_found_across_chunks(spark):
    from weftline.operators import alignment as A

    rows = [("f", k, f"Call `step_{k}` now.", f"`step_{k}`를 부릅니다.") for k in range(60)]
    rows[29], rows[30] = ("f", 29, rows[29][2], rows[30][3]), ("f", 30, rows[30][2], rows[29][3])
    rows.append(("f", 60, None, None))
    df = spark.createDataFrame(rows, "path string, at int, source string, translation string")
    want = {("f", 29, 1, ("`step_30",)), ("f", 30, -1, ("`step_29",))}
    for chunk in (3, 30, 1000):
        got = {(r.file, r["at"], r["offset"], tuple(r.anchors)) for r in A.misaligned_in_sequence(df, "path", "at", "source", "translation", chunk=chunk).collect()}
        assert {(a, b, c) for a, b, c, _ in got} == {(a, b, c) for a, b, c, _ in want}, chunk
    assert A.misaligned_in_sequence(df.limit(0), "path", "at", "source", "translation").count() == 0


def test_renames(spark):
    files = [("n1", h) for h in range(10)] + [("n2", h) for h in (1, 99)]
    orphans = [("o1", h) for h in range(6)] + [("o2", h) for h in range(5, 8)] + [("o3", h) for h in range(3)]
    frame = lambda rows: spark.createDataFrame(rows, "name string, hash bigint")
    pairs = S.renamed_files(frame(files), frame(orphans))
    assert {(r.file, r.orphan, r.shared) for r in pairs.collect()} == {("n1", "o1", 6), ("n2", "o1", 1), ("n2", "o3", 1)}
    assert {(r.file, r.orphan) for r in S.claim_orphans(pairs).collect()} == {("n1", "o1"), ("n2", "o3")}


def test_coverage(spark):
    docs = spark.createDataFrame([(1, "one\n\n```\ncode\n---\nmore\n```\ntwo"), (2, ""), (3, None)], "id int, text string")
    lines = V.fenced(V.text_lines(docs, "id", "text"), "id").withColumn("offered", ~F.col("code"))
    assert {(r.id, r.word_lines, r.offered_lines, r.ratio) for r in V.coverage(lines, "id", "offered").collect()} == {(1, 4, 2, 0.5), (2, 0, 0, 1.0)}
    assert [(r.first_line, r.last_line, r.lines) for r in V.gaps(lines, "id", "offered").collect()] == [(3, 5, 2)]


def test_spans_touch_lines(spark):
    lines = spark.createDataFrame([(1, 0, 0, 4), (1, 1, 5, 9), (1, 2, 10, 9000)], "id int, line int, at bigint, to bigint")
    spans = spark.createDataFrame([(1, 4, 5), (1, 8990, 8990)], "id int, start bigint, end bigint")
    assert [r.offered for r in V.covered_by_spans(lines, spans, "id").orderBy("line").collect()] == [True, True, True]


def test_terms(spark):
    counted = spark.createDataFrame([("ray", 10), ("ray class", 10), ("class group", 9), ("ray class group", 9), ("groups", 2), ("group", 30)], "ngram string, n bigint")
    folded = {r.ngram: r.n for r in M.fold_plurals(counted).collect()}
    assert folded["group"] == 32 and "groups" not in folded
    assert {r.ngram for r in M.open_ngrams(counted).collect()} == {"ray class group", "groups", "group"}


def test_nearest_rank(spark):
    rows = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4)] + [(None,)], "v double")
    assert {(r.percent, r.value) for r in E.nearest_rank(rows, "v", [0, 50, 100]).collect()} == {(0.0, 1.0), (50.0, 3.0), (100.0, 4.0)}
    assert E.nearest_rank(rows.filter("v is null"), "v", [50]).count() == 0


def test_wilson_and_fold(spark):
    replies = spark.createDataFrame([(1, "j", "m", "b", "c", "AB", "candidate"), (1, "j", "m", "b", "c", "BA", "candidate"), (2, "j", "m", "b", "c", "AB", "baseline"), (2, "j", "m", "b", "c", "BA", "candidate"), (3, "j", "m", "b", "c", "AB", "tie")], "pick int, judge string, model string, baseline string, candidate string, shown_order string, side string")
    assert {(r.pick, r.side) for r in E.fold_orders(replies).collect()} == {(1, "candidate"), (2, "tie")}
    assert E.fold_orders(replies, single_stands=True).count() == 3
    t = E.tally(E.fold_orders(replies), ["candidate"]).first()
    z, n, p = 1.96, 1, 1.0
    assert math.isclose(t.low, (p + z * z / 2 / n - z * math.sqrt(z * z / 4 / n / n)) / (1 + z * z / n))
    none = E.tally(E.fold_orders(replies).filter("side = 'tie'"), ["candidate"]).first()
    assert none.rate is None and none.low is None


def test_capped_sample(spark):
    rows = spark.createDataFrame([(f"i{k % 3}", f"b{k}", k % 2 == 0) for k in range(30)], "item string, block string, hard boolean")
    got = E.capped_sample(rows, 1, ["item", "block"], "item", 4, F.col("hard"), 5, 10).collect()
    assert len(got) == 10 and max(sum(r.item == f"i{k}" for r in got) for k in range(3)) <= 4 and sum(r.hard for r in got) >= 5


def test_tables(spark):
    from weftline.operators import tables as B

    text = "x\n| Name | Note |\n|---|---|\n| a | b |\n\n| 1 |\n"
    cells = B.pipe_tables(spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, t string"), "id", "t")
    assert {(r.table_no, r.table_row, r.column, r.text) for r in cells.collect()} == {(1, 0, 0, "Name"), (1, 0, 1, "Note"), (1, 1, 0, "a"), (1, 1, 1, "b"), (2, 0, 0, "1")}
    ruled = B.apply_rules(cells, ["id", "table_no"], [{"headers": ["NOTE"], "skip": ["name"]}])
    assert {r.text for r in ruled.filter("not offered").collect()} == {"a"}
    assert B.table_profile(ruled, ["id", "table_no"]).filter("excluded = 1").first().samples == ["a"]


def test_human_pairs(spark):
    rows = spark.createDataFrame([(f"i{k}", "b", k < 3) for k in range(20)], "item string, block string, hard boolean")
    got = E.human_pairs(rows, ["x", "y"], 1, 10, F.col("hard")).collect()
    assert len(got) == 10 and sum(r.candidate == "x" for r in got) == 5


def test_names_are_no_plurals(spark):
    counted = spark.createDataFrame([("windows", 10, 10), ("window", 20, 1), ("tables", 4, 0), ("table", 3, 0)], "ngram string, n bigint, capitals bigint")
    assert {r.ngram: r.n for r in M.fold_plurals(counted).collect()} == {"windows": 10, "window": 20, "table": 7}


def test_whole_variants(spark):
    rows = [("Abstract:", "초록"), ("**Abstract**", "요약"), ("Abstract", None), ("and so", "x"), ("and so", "y"), (None, "z")]
    got = M.whole_variants(spark.createDataFrame(rows, "s string, t string"), "s", "t").collect()
    assert [(r.term, r.n, r.variants) for r in got] == [("abstract", 3, ["요약", "초록"])]


def test_neighbours_across_chunks(spark):
    rng = random.Random(5)
    rows = [(f, p, None if rng.random() < 0.2 else rng.randrange(99)) for f in ("a", "b", None) for p in rng.sample(range(60), 25)]
    got = {(r.path, r.at): (r.before_v, r.after_v) for r in S.neighbours(spark.createDataFrame(rows, "path string, at bigint, v int"), "path", "at", "v", chunk=7).collect()}
    for f in ("a", "b", None):
        own = sorted((p, v) for g, p, v in rows if g == f)
        for k, (p, _) in enumerate(own):
            assert got[f, p] == (own[k - 1][1] if k else None, own[k + 1][1] if k + 1 < len(own) else None)
    assert len(got) == len(rows)


def test_agreement_equals_all_pairs(spark):
    rng = random.Random(21)
    rows = [(p, f"j{j}", "m", rng.choice(["baseline", "candidate", "tie"])) for p in range(60) for j in range(7) if rng.random() < 0.6]
    want = {}
    for p, a, _, x in rows:
        for q, b, _, y in rows:
            if p == q and a < b:
                n, m = want.get((f"{a}/m", f"{b}/m"), (0, 0))
                want[f"{a}/m", f"{b}/m"] = n + 1, m + (x == y)
    df = spark.createDataFrame(rows, "pick int, judge string, model string, side string")
    assert {(r.judge_a, r.judge_b): (r.picks, r.agreed) for r in E.agreement(df).collect()} == want
    assert E.agreement(df.limit(0)).count() == 0
