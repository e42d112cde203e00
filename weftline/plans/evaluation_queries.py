"""Queries on evaluation tables: gates, verdicts, samples, manifests, requests and calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import columns as C
from weftline.functions import udfs as U
from weftline.operators import evaluation as E
from weftline.operators import gating as G
from weftline.operators import models as M
from weftline.operators import reports as R
from weftline.plans.sql_hash import with_xxh64
from weftline.session import spread
from weftline.sources.tables import table


def _gates(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "gate_rows")


def gate_rates(spark: SparkSession, folder: str) -> DataFrame:
    return E.gate_rates(_gates(spark, folder).filter("repeat_no = 0"), ["candidate", "variant"])


def failed_checks(spark: SparkSession, folder: str) -> DataFrame:
    return E.failed_checks(_gates(spark, folder), ["candidate"])


def gate_conjunction(spark: SparkSession, folder: str) -> DataFrame:
    """A row passes if all its checks do; how often the stored result says so."""
    every = F.forall(F.map_values("checks"), lambda ok: ok)
    return _gates(spark, folder).groupBy(every.alias("all_checks"), "passed").agg(F.count("*").alias("rows"))


def passing_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks that pass finally under every candidate that has them."""
    rows = _gates(spark, folder).filter("variant = 'final' and repeat_no = 0")
    return rows.groupBy("item", "block").agg(F.every("passed").alias("ok"), F.count_distinct("candidate").alias("candidates")).filter("ok").select("item", "block", "candidates")


def repaired_share(spark: SparkSession, folder: str) -> DataFrame:
    return _gates(spark, folder).cube("candidate", "variant").agg(F.count_if("repaired").alias("repaired"), F.count("*").alias("rows"), F.grouping_id().cast("int").alias("level"))


def gate_issue_patterns(spark: SparkSession, folder: str) -> DataFrame:
    """Issue messages by their pattern, numbers and quoted parts left out."""
    text = F.regexp_replace(F.regexp_replace(F.col("issue"), r"`[^`]*`|\"[^\"]*\"", "#"), r"[0-9]+", "#")
    rows = _gates(spark, folder).select("candidate", F.explode("issues").alias("issue")).groupBy(text.alias("pattern")).agg(F.count("*").alias("n"), F.count_distinct("candidate").alias("candidates"))
    return rows


def gate_issues(spark: SparkSession, folder: str, most: int = 50) -> DataFrame:
    """The `most` commonest patterns, a top-k report; gate_issue_patterns has all."""
    return gate_issue_patterns(spark, folder).orderBy(F.desc("n"), "pattern").limit(most)


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "judge_pairs", "vote_id", "pick_id", "judge", "judge_model", "baseline", "candidate", "item", "block", "shown_order", "verdicts")


def pair_fold(spark: SparkSession, folder: str) -> DataFrame:
    return E.fold_orders(E.last_replies(_pairs(spark, folder))).select("pick", "judge", "model", "side")


def pair_fold_viewer(spark: SparkSession, folder: str) -> DataFrame:
    return E.fold_orders(E.last_replies(_pairs(spark, folder)), single_stands=True).select("pick", "judge", "model", "side")


def win_rates(spark: SparkSession, folder: str) -> DataFrame:
    found = E.tally(E.fold_orders(E.last_replies(_pairs(spark, folder))), ["baseline", "candidate"])
    return found.select("baseline", "candidate", "wins", "losses", "ties", *(F.round(c, 9).alias(c) for c in ("rate", "low", "high")))


def judge_win_rates(spark: SparkSession, folder: str) -> DataFrame:
    found = E.tally(E.fold_orders(E.last_replies(_pairs(spark, folder))), ["judge", "model"])
    return found.select("judge", "model", "wins", "losses", "ties", *(F.round(c, 9).alias(c) for c in ("rate", "low", "high")))


def judge_agreement(spark: SparkSession, folder: str) -> DataFrame:
    return E.agreement(E.fold_orders(E.last_replies(_pairs(spark, folder))))


def verdict_pivot(spark: SparkSession, folder: str) -> DataFrame:
    rows = _pairs(spark, folder).select("shown_order", E.verdict(F.col("verdicts.overall")).alias("side")).filter("side is not null")
    return rows.groupBy("shown_order").pivot("side", ["baseline", "candidate", "tie"]).agg(F.count(F.lit(1))).na.fill(0)


def seeded_subset(spark: SparkSession, folder: str) -> DataFrame:
    return E.seeded_subset(table(spark, folder, "eval_items", "item"), 7, 50, "item").select("item")


def item_pick(spark: SparkSession, folder: str) -> DataFrame:
    """One item a source file: those of at least 8 segments first, then in seeded order."""
    rows = table(spark, folder, "eval_items", "item", "source_path", "blocks").withColumn("n", F.aggregate("blocks", F.lit(0), lambda a, b: a + F.size(b["segments"])))
    return E.first_per_group(rows, ["source_path"], [~(F.col("n") >= 8), U.seeded_key(7, "item"), F.col("item")]).select("source_path", "item")


def round_robin(spark: SparkSession, folder: str) -> DataFrame:
    return E.round_robin(table(spark, folder, "eval_items", "item", "project"), "project", 7, "item", 6, 1, 100).select("item", "project", "round", "place")


def _blocks(spark: SparkSession, folder: str) -> DataFrame:
    b = table(spark, folder, "eval_items", "item", "project", "parser", "kind", "blocks").select("item", "project", "parser", "kind", F.explode("blocks").alias("b"))
    return b.select("item", "project", "parser", "kind", F.col("b.id").alias("block"), F.col("b.raw").alias("raw"), F.col("b.strata").alias("strata"), F.col("b.segments").alias("segments"))


def judge_sample(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks to judge: all hard ones with a reference, synthetic ones with telling probes, and a capped sample of real ones, hard strata first."""
    b = table(spark, folder, "eval_items", "item", "kind", "blocks").select("item", "kind", F.explode("blocks").alias("b")).select("item", "kind", F.col("b.id").alias("block"), F.col("b.strata").alias("strata"), F.col("b.probes").alias("probes"), F.col("b.segments").alias("segments"))
    among = lambda column, *names: F.coalesce(F.exists(column, lambda s: s.isin(*names)), F.lit(False))
    letters = F.aggregate("segments", F.lit(0), lambda n, s: n + F.coalesce(F.length(s["source"]), F.lit(0)))
    real = b.filter(F.col("kind") == "real").filter(~among("strata", "trivial", "heading") & (letters >= 60))
    sample = E.capped_sample(real, 7, ["item", "block"], "item", 4, among("strata", "inline-markup", "long", "math"), 40, 120)
    hard = b.filter(F.col("kind") == "hard").filter(F.exists("segments", lambda s: s["reference"].isNotNull()))
    probed = b.filter(F.col("kind") == "synthetic").filter(F.coalesce(F.exists("probes", lambda p: ~p.isin("latex-aux", "noun-heading")), F.lit(False)))
    return hard.unionByName(probed).unionByName(sample).select("item", "block", "kind")


def block_strata(spark: SparkSession, folder: str) -> DataFrame:
    rows = _blocks(spark, folder)
    return rows.select("item", "block", F.sort_array(C.strata("raw", F.transform("segments", lambda s: s["source"]))).alias("strata"))


def manifest_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks and items by project and kind, by parser, and by stored stratum, in one pass."""
    name = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("name"))
    own = F.array(name("project", F.concat_ws("/", "project", "kind")), name("parser", F.col("parser")))
    names = F.concat(own, F.coalesce(F.transform("strata", lambda s: name("stratum", s)), F.array().cast("array<struct<kind:string,name:string>>")))
    rows = _blocks(spark, folder).select("item", F.explode(names).alias("n")).groupBy("n.kind", "n.name", "item").agg(F.count("*").alias("c"))
    return rows.groupBy("kind", "name").agg(F.sum("c").alias("blocks"), F.count("*").alias("items"))


def length_ratio_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "segment_states", "source", "translation").filter("translation is not null and length(source) >= 40")
    return E.nearest_rank(rows.select(C.length_ratio("source", "translation").alias("ratio")), "ratio", [0.01, 0.5, 1, 5, 50]).select("percent", F.round("value", 9).alias("value"))


def truncation_thresholds(spark: SparkSession, folder: str) -> DataFrame:
    """One row: segments of 40 characters and more, and the length ratios below which a text looks cut; min_ratio is the percentile 0.01."""
    rows = table(spark, folder, "segment_states", "source", "translation").filter("translation is not null and length(source) >= 40")
    ratios = rows.select(C.length_ratio("source", "translation").alias("ratio"))
    names = {0.01: "min_ratio", 0.5: "p0_5", 1.0: "p1", 5.0: "p5", 50.0: "p50"}
    found = E.nearest_rank(ratios, "ratio", list(names)).agg(*(F.max(F.when(F.col("percent") == p, F.round("value", 4))).alias(n) for p, n in names.items()))
    return found.select(F.lit(ratios.count()).cast("bigint").alias("segments"), *names.values())


def first_attempts(spark: SparkSession, folder: str) -> DataFrame:
    """How many segments the first call without an error was asked for, and how many replies came."""
    rows = table(spark, folder, "eval_outputs", "out_id", "calls", "first_replies")
    good = F.filter("calls", lambda c: c["error"].isNull())
    return rows.select("out_id", F.size(F.get(good, F.lit(0))["requested"]).alias("asked"), F.size(F.map_filter("first_replies", lambda k, v: v.isNotNull())).alias("answered"))


def call_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Calls, failed calls and summed time of each candidate, rows written twice counted once."""
    rows = table(spark, folder, "eval_outputs", "out_id", "item", "candidate", "repeat_no", "calls", "duration_ms")
    once = E.first_per_group(rows, ["item", "candidate", "repeat_no"], [F.col("out_id")])
    return once.groupBy("candidate").agg(F.count("*").alias("requests"), F.sum(F.size("calls")).alias("calls"), F.sum(F.size(F.filter("calls", lambda c: c["error"].isNotNull()))).alias("failed"), F.sum("duration_ms").alias("milliseconds"))


def attempts(spark: SparkSession, folder: str) -> DataFrame:
    """Final translations by number of attempts and issues."""
    rows = table(spark, folder, "eval_outputs", "candidate", "finals").select("candidate", F.explode("finals").alias("pos", "f"))
    return rows.groupBy("candidate", F.col("f.attempts").alias("attempts")).agg(F.count("*").alias("finals"), F.sum(F.size("f.issues")).alias("issues"))


def missing_outputs(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates without an output for an item: what a resumed run still has to do."""
    items = table(spark, folder, "eval_items", "item")
    done = table(spark, folder, "eval_outputs", "item", "candidate").distinct()
    # candidates are a small dimension with a checked size; the items stay distributed
    names = [r[0] for r in done.select("candidate").distinct().orderBy("candidate").limit(1001).collect()]
    if len(names) > 1000:
        raise ValueError("more than 1000 candidates")
    wanted = items.withColumn("candidate", F.explode(F.array(*(F.lit(n) for n in names)) if names else F.array().cast("array<string>")))
    return wanted.join(done, ["item", "candidate"], "left_anti")


def planned_match(spark: SparkSession, folder: str) -> DataFrame:
    """Items that ask for the same list of sources as another one."""
    rows = table(spark, folder, "eval_items", "item", "blocks").select("item", F.flatten(F.transform("blocks", lambda b: F.transform(b["segments"], lambda s: s["source"]))).alias("sources"))
    return rows.groupBy("sources").agg(F.count("*").alias("items"), F.min("item").alias("first")).filter("items > 1").select("first", "items")


def segment_references(spark: SparkSession, folder: str) -> DataFrame:
    """Edit distance between a final translation and its reference, where there is one."""
    ref = _blocks(spark, folder).select("item", F.explode("segments").alias("s")).select("item", F.col("s.index").alias("pos"), F.col("s.reference").alias("reference")).filter("reference is not null")
    fin = table(spark, folder, "eval_outputs", "out_id", "item", "finals").select("out_id", "item", F.explode("finals").alias("pos", "f")).select("out_id", "item", "pos", F.col("f.translation").alias("translation")).filter("translation is not null")
    return fin.join(ref, ["item", "pos"]).select("out_id", "pos", F.levenshtein("translation", "reference").alias("distance"))


def _candidates(spark: SparkSession, folder: str) -> list[str]:
    names = [r[0] for r in _gates(spark, folder).select("candidate").distinct().orderBy("candidate").limit(1001).collect()]
    if len(names) > 1000:
        raise ValueError("more than 1000 candidates")
    return names


def human_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks that pass under several candidates; a fifth of them from items that are not real text."""
    kinds = table(spark, folder, "eval_items", "item", "kind").dropDuplicates(["item"])
    passing = passing_blocks(spark, folder).join(kinds, "item", "left")
    return E.human_pairs(passing, _candidates(spark, folder), 7, 30, F.col("kind") != "real")


def report_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates against the system that is the baseline most often."""
    pairs = _pairs(spark, folder)
    base = pairs.groupBy("baseline").count().orderBy(F.desc("count"), "baseline").first()
    return E.decision(gate_rates(spark, folder), win_rates(spark, folder), base["baseline"] if base else "")


def block_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Presence, alert markers and length of every block of every output, first replies and final texts."""
    return G.block_checks(table(spark, folder, "eval_outputs"), table(spark, folder, "eval_items"), 0.22)


def block_gates(spark: SparkSession, folder: str) -> DataFrame:
    """All checks of every block."""
    rows = G.block_gates(spread(table(spark, folder, "eval_outputs"), "item"), table(spark, folder, "eval_items"), 0.22)
    return rows.select("out_id", "variant", "block", "passed", F.array_join(F.array_sort(F.map_keys(F.map_filter("checks", lambda k, ok: ~ok))), " ").alias("failed"), "repaired")


def gate_report(spark: SparkSession, folder: str) -> DataFrame:
    return R.gate_table(gate_rates(spark, folder))


def viewer_pages(spark: SparkSession, folder: str) -> DataFrame:
    """How many blocks and candidates the side-by-side page of each item shows."""
    pages = R.viewer_pages(table(spark, folder, "eval_items"), table(spark, folder, "eval_outputs"))
    return pages.select("item", F.json_array_length(F.get_json_object("page", "$.blocks")).alias("blocks"), F.json_array_length(F.get_json_object("page", "$.sides")).alias("candidates"))


def judging_plan(spark: SparkSession, folder: str) -> DataFrame:
    """What is still to be judged: picks by judges and orders without a reply that stands."""
    pairs = table(spark, folder, "judge_pairs", "pick_id", "baseline", "candidate", "judge", "judge_model", "shown_order", "error")
    return M.judging_plan(pairs, pairs.filter("judge is not null and judge_model is not null"), pairs)


def judged_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks of each item judged between the two candidates with the first names, in both orders, by a deterministic judge for which the longer text wins."""
    outs = table(spark, folder, "eval_outputs", "out_id", "item", "candidate", "repeat_no", "finals").filter("repeat_no = 0")
    texts = G.variants(outs.withColumn("first_replies", F.create_map().cast("map<int,string>"))).filter("variant = 'final'").groupBy("item", "candidate").agg(F.max_by("texts", "out_id").alias("texts"))
    names = _candidates(spark, folder)[:2]
    if len(names) < 2:
        return table(spark, folder, "judge_pairs", "pick_id").limit(0).select(F.lit("").alias("item"), F.lit("").alias("shown_order"), F.lit("").alias("overall"), F.lit(0).alias("attempts"))
    joined = F.array_join(F.map_values("texts"), " ")
    one, two = (texts.filter(F.col("candidate") == n).select("item", joined.alias(c)) for n, c in zip(names, ("baseline_text", "candidate_text")))
    sources = G.item_segments(table(spark, folder, "eval_items")).groupBy("item").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "source"))), lambda s: s["source"]), " ").alias("source"))
    rows = one.join(two, "item").join(sources, "item").select(F.col("item").alias("pick_id"), F.lit(names[0]).alias("baseline"), F.lit(names[1]).alias("candidate"), F.lit("length").alias("judge"), F.lit("fixed").alias("judge_model"), F.explode(F.array(F.lit("AB"), F.lit("BA"))).alias("shown_order"), "source", "baseline_text", "candidate_text")
    found = M.judge(rows, M.HashJudge)
    return found.select(F.col("pick_id").alias("item"), "shown_order", F.col("verdicts.overall").alias("overall"), "attempts")


def changed_translations(spark: SparkSession, folder: str) -> DataFrame:
    """Deliveries that give a segment of the same source another translation, with the one before: what was mended."""
    rows = table(spark, folder, "segment_states", "feed_id", "path", "seg_id", "source", "source_hash", "translation").filter("translation is not null")
    w = Window.partitionBy("path", "seg_id").orderBy("feed_id")
    near = rows.withColumn("was", F.lag(F.struct("source_hash", "translation")).over(w))
    return near.filter((F.col("was.source_hash") == F.col("source_hash")) & (F.col("was.translation") != F.col("translation"))).select("feed_id", "source", F.col("translation").alias("mended"), F.col("was.translation").alias("bad"))


def hard_items(spark: SparkSession, folder: str) -> DataFrame:
    """Segments of evaluation items whose source had a translation mended: the latest mended and the bad one beside them."""
    fixes = changed_translations(spark, folder).groupBy("source").agg(F.max_by(F.struct("mended", "bad"), "feed_id").alias("f"))
    return G.item_segments(table(spark, folder, "eval_items")).join(fixes, "source").select("item", "block", "pos", "f.mended", "f.bad")


def nontrivial_items(spark: SparkSession, folder: str) -> DataFrame:
    """Items with any segment that is not trivial."""
    return G.item_segments(table(spark, folder, "eval_items")).groupBy("item").agg(F.max((~C.trivial("source")).cast("int")).alias("n")).filter("n = 1").select("item")


QUERIES = {f.__name__: f for f in (gate_rates, failed_checks, gate_conjunction, passing_blocks, repaired_share, gate_issue_patterns, gate_issues, pair_fold, pair_fold_viewer, win_rates, judge_win_rates, judge_agreement, verdict_pivot, seeded_subset, item_pick, round_robin, judge_sample, block_strata, manifest_counts, length_ratio_percentiles, truncation_thresholds, first_attempts, call_totals, attempts, missing_outputs, planned_match, segment_references, human_pairs, report_decisions, block_checks, block_gates, gate_report, viewer_pages, judging_plan, judged_pairs, changed_translations, hard_items, nontrivial_items)}

_LAST = """
(select pick_id as pick, judge, judge_model as model, baseline, candidate, shown_order, side from (
  select *, lower(trim(verdicts.overall)) as side from judge_pairs) where side in ('baseline', 'candidate', 'tie') and shown_order is not null
  qualify row_number() over (partition by pick_id, judge, judge_model, baseline, candidate, shown_order order by vote_id desc) = 1)
"""
_FOLD = f"(select pick, judge, model, baseline, candidate, count(*) as orders, case when min(side) = max(side) then min(side) else 'tie' end as side from {_LAST} group by 1, 2, 3, 4, 5)"


def _tally(by: str) -> str:
    return f"""
with t as (select {by}, count(*) filter (where side = 'candidate') as wins, count(*) filter (where side = 'baseline') as losses, count(*) filter (where side = 'tie') as ties from {_FOLD} where orders = 2 group by {by}),
r as (select *, (wins + losses)::double as n, wins / nullif(wins + losses, 0) as p from t)
select {by}, wins, losses, ties, round(p, 9) as rate,
  round(case when n > 0 then (p + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) - 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n)) / (1 + 1.96 * 1.96 / n) end, 9) as low,
  round(case when n > 0 then (p + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) + 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n)) / (1 + 1.96 * 1.96 / n) end, 9) as high
from r
"""


#: Items with the unsigned XXH64 of seed and id.
_SEEDED = with_xxh64("(select *, '7:' || item as _t from eval_items)", "_t", "_k")
_BLOCKS = "(select item, project, parser, kind, b.id as block, b.raw as raw, b.strata as strata, b.segments as segments from (select *, unnest(blocks) as b from eval_items))"

ORACLE = {
    "gate_rates": "select candidate, variant, count(*) as rows, count(*) filter (where passed) as passed, count(*) filter (where passed) / count(*) as rate from gate_rows where repeat_no = 0 group by 1, 2",
    "failed_checks": 'select candidate, e.key as "check", count(*) as failed from (select candidate, unnest(map_entries(checks)) as e from gate_rows) where not e.value group by 1, 2',
    "gate_conjunction": "select coalesce(list_bool_and(map_values(checks)), true) as all_checks, passed, count(*) as rows from gate_rows group by 1, 2",
    "passing_blocks": "select item, block, count(distinct candidate) as candidates from gate_rows where variant = 'final' and repeat_no = 0 group by 1, 2 having bool_and(passed)",
    "repaired_share": "select candidate, variant, count(*) filter (where repaired) as repaired, count(*) as rows, grouping(candidate, variant)::int as level from gate_rows group by cube (candidate, variant)",
    "gate_issue_patterns": "select regexp_replace(regexp_replace(issue, '`[^`]*`|\"[^\"]*\"', '#', 'g'), '[0-9]+', '#', 'g') as pattern, count(*) as n, count(distinct candidate) as candidates from (select candidate, unnest(issues) as issue from gate_rows) group by 1",
    "pair_fold": f"select pick, judge, model, side from {_FOLD} where orders = 2",
    "pair_fold_viewer": f"select pick, judge, model, side from {_FOLD}",
    "win_rates": _tally("baseline, candidate"),
    "judge_win_rates": _tally("judge, model"),
    "judge_agreement": f"with f as (select pick, judge || '/' || model as j, side from {_FOLD} where orders = 2) select a.j as judge_a, b.j as judge_b, count(*) as picks, count(*) filter (where a.side = b.side) as agreed from f a join f b on a.pick = b.pick and a.j < b.j group by 1, 2",
    "verdict_pivot": "select shown_order, count(*) filter (where s = 'baseline') as baseline, count(*) filter (where s = 'candidate') as candidate, count(*) filter (where s = 'tie') as tie from (select shown_order, lower(trim(verdicts.overall)) as s from judge_pairs) where s in ('baseline', 'candidate', 'tie') group by 1",
    "seeded_subset": f"select item from ({_SEEDED}) order by _k, item limit 50",
    "item_pick": f"select source_path, item from ({_SEEDED}) qualify row_number() over (partition by source_path order by list_sum(list_transform(blocks, lambda b: len(b.segments))) >= 8 desc, _k, item) = 1",
    "round_robin": f"""
with p as (select item, project, (row_number() over (partition by project order by _k, item) - 1)::int as round from ({_SEEDED})),
q as (select *, row_number() over (order by round, project)::int as place from p where round < 6)
select item, project, round, place from q where round < 1 or place <= 100
""",
    "block_strata": f"""
with b as (select item, block, coalesce(raw, '') as r, regexp_replace(coalesce(raw, ''), '^\\s+', '') as h, list_transform(coalesce(segments, []), lambda s: coalesce(s.source, '')) as s from {_BLOCKS}),
t as (select *, (length(r) - length(replace(r, '`', ''))) + (length(r) - length(replace(r, '](', ''))) / 2 + (length(r) - length(replace(r, '**', ''))) / 2 as marks,
  len(list_filter(s, lambda x: not (length(x) < 20 or length(regexp_replace(regexp_replace(regexp_replace(x, '`[^`]*(`|$)', '', 'g'), '\\]\\([^)]*(\\)|$)', '', 'g'), '[^\\p{{L}}]', '', 'g')) < 12))) = 0 as triv from b),
g as (select item, block, list_filter([
  case when len(s) >= 4 then 'long' end, case when marks >= 4 then 'inline-markup' end,
  case when contains(r, '$') or contains(r, '\\(') or contains(r, ':math:') or contains(r, '\\begin{{equation') then 'math' end,
  case when starts_with(h, '- ') or starts_with(h, '* ') or starts_with(h, '\\item') then 'list' end,
  case when starts_with(h, '|') then 'table' end,
  case when starts_with(h, '#') or starts_with(h, '\\section') or starts_with(h, '\\chapter') then 'heading' end,
  case when triv then 'trivial' end], lambda x: x is not null) as f from t)
select item, block, list_sort(case when len(f) = 0 then ['prose'] when f = ['long'] then ['long', 'prose'] else f end) as strata from g
""",
    "manifest_counts": f"""
select 'project' as kind, project || '/' || kind as name, count(*) as blocks, count(distinct item) as items from {_BLOCKS} group by 2
union all select 'parser', parser, count(*), count(distinct item) from {_BLOCKS} group by 2
union all select 'stratum', s, count(*), count(distinct item) from (select item, unnest(strata) as s from {_BLOCKS}) group by 2
""",
    "length_ratio_percentiles": """
with r as (select length(translation) / length(source) as v from segment_states where translation is not null and length(source) >= 40),
s as (select v, row_number() over (order by v) - 1 as i, count(*) over () as n from r)
select p as percent, round(v, 9) as value from s join (select unnest([0.01, 0.5, 1.0, 5.0, 50.0])::double as p) on i = floor(p / 100 * (n - 1) + 0.5)
""",
    "first_attempts": "select out_id, len(list_filter(calls, lambda c: c.error is null)[1].requested)::int as asked, len(list_filter(map_values(first_replies), lambda v: v is not null))::int as answered from eval_outputs",
    "call_totals": """
select candidate, count(*) as requests, sum(len(calls))::bigint as calls, sum(len(list_filter(calls, lambda c: c.error is not null)))::bigint as failed, sum(duration_ms)::bigint as milliseconds
from (select * from eval_outputs qualify row_number() over (partition by item, candidate, repeat_no order by out_id) = 1) group by candidate
""",
    "attempts": "select candidate, e.value.attempts as attempts, count(*) as finals, sum(len(e.value.issues))::bigint as issues from (select candidate, unnest(map_entries(finals)) as e from eval_outputs) group by 1, 2",
    "missing_outputs": "select i.item, c.candidate from eval_items i cross join (select distinct candidate from eval_outputs) c where not exists (select 1 from eval_outputs o where o.item = i.item and o.candidate = c.candidate)",
    "planned_match": "with s as (select item, flatten(list_transform(blocks, lambda b: list_transform(b.segments, lambda s: s.source))) as sources from eval_items) select min(item) as first, count(*) as items from s group by sources having count(*) > 1",
    "segment_references": f"""
with r as (select item, s.index as pos, s.reference as reference from (select item, unnest(segments) as s from {_BLOCKS}) where s.reference is not null),
f as (select out_id, item, e.key as pos, e.value.translation as t from (select out_id, item, unnest(map_entries(finals)) as e from eval_outputs))
select out_id, f.pos, null::int as distance from f join r using (item, pos) where t is not null
""",
}
ORACLE["truncation_thresholds"] = f"""
with p as ({ORACLE["length_ratio_percentiles"]})
select (select count(*) from segment_states where translation is not null and length(source) >= 40) as segments, round(max(value) filter (where percent = 0.01), 4) as min_ratio, round(max(value) filter (where percent = 0.5), 4) as p0_5,
  round(max(value) filter (where percent = 1.0), 4) as p1, round(max(value) filter (where percent = 5.0), 4) as p5, round(max(value) filter (where percent = 50.0), 4) as p50 from p
"""
ORACLE["gate_issues"] = ORACLE["gate_issue_patterns"] + " order by n desc, pattern limit 50"
ORACLE["judge_sample"] = f"""
with b as (select item, kind, b.id as block, b.strata as strata, b.probes as probes, b.segments as segments from (select item, kind, unnest(blocks) as b from eval_items)),
r as (select * from ({with_xxh64("(select *, '7:' || item || ':' || block as _t from b)", "_t", "_k")}) where kind = 'real' and not list_has_any(coalesce(strata, []), ['trivial', 'heading']) and coalesce(list_sum(list_transform(segments, lambda s: length(s.source))), 0) >= 60),
h as (select * from (select * from r where list_has_any(coalesce(strata, []), ['inline-markup', 'long', 'math']) qualify row_number() over (partition by item order by _k) <= 4) order by _k limit 40),
t as (select item, count(*) as c from h group by 1),
o as (select * from (select r.item, r.block, r.kind, r._k from r left join t using (item) where not exists (select 1 from h where h.item = r.item and h.block = r.block)
  qualify row_number() over (partition by r.item order by r._k) + coalesce(t.c, 0) <= 4) order by _k limit (select 120 - count(*) from h))
select item, block, kind from b where kind = 'hard' and len(list_filter(segments, lambda s: s.reference is not null)) > 0
union all select item, block, kind from b where kind = 'synthetic' and len(list_filter(probes, lambda p: p not in ('latex-aux', 'noun-heading'))) > 0
union all select item, block, kind from h union all select item, block, kind from o
"""
ORACLE["human_pairs"] = f"""
with p as (select item, block, coalesce(kind <> 'real', false) as s from ({ORACLE["passing_blocks"]}) left join (select distinct item, kind from eval_items) using (item)),
k as ({with_xxh64("(select *, 'human:7:' || item || ':' || block as _t from p)", "_t", "_k")}),
f as (select * from (select * from k where s order by _k limit 6) union all select * from (select * from k where not s order by _k limit 30)),
n as (select item, block, (row_number() over (order by s desc, _k) - 1)::int as place from f),
c as (select list(candidate order by candidate) as names from (select distinct candidate from gate_rows))
select item, block, place, names[place % len(names) + 1] as candidate, _h % 2 = 0 as baseline_first
from ({with_xxh64("(select *, 'side:7:' || place as _t from n where place < 30)", "_t", "_h")}), c
"""
ORACLE["report_decisions"] = f"""
with base as (select baseline as b from judge_pairs group by 1 order by count(*) desc, 1 limit 1),
r as ({ORACLE["gate_rates"]}), w as ({_tally("baseline, candidate")}),
g as (select r.candidate, bool_and(r.rate >= o.rate) as gates_hold from r join r o on o.variant = r.variant and o.candidate = (select b from base) where r.candidate <> (select b from base) group by 1)
select g.candidate, gates_hold, coalesce(w.low > 0.5, false) as judges_hold from g left join w on w.candidate = g.candidate and w.baseline = (select b from base)
"""
_SEGS = f"(select item, block, s.index as pos, s.source as source from (select item, block, unnest(segments) as s from {_BLOCKS}))"
_TEXTS = """(select out_id, item, 'first' as variant, e.key as pos, e.value as t from (select out_id, item, unnest(map_entries(first_replies)) as e from eval_outputs)
union all select out_id, item, 'final', e.key, e.value.translation from (select out_id, item, unnest(map_entries(finals)) as e from eval_outputs))"""
_SENTS = "greatest(1, len(regexp_extract_all({0} || ' ', '(?:^|[^0-9.?!。])[.?!。]\\s|[^0-9][.?!。]\\s')))"
_MARKS = "list_sort(regexp_extract_all({0}, '\\[![^\\]]*\\]?'))"
_CHANGED = """
select feed_id, source, translation as mended, bad from (
  select *, lag(translation) over w as bad, lag(source_hash) over w as h from segment_states where translation is not null window w as (partition by path, seg_id order by feed_id))
where h = source_hash and bad <> translation
"""
ORACLE |= {
    "block_checks": f"""
with o as (select out_id, item, unnest(['first', 'final']) as variant from eval_outputs),
r as (select o.out_id, o.variant, s.block, s.source, x.t from o join {_SEGS} s using (item) left join {_TEXTS} x on x.out_id = o.out_id and x.variant = o.variant and x.pos = s.pos)
select out_id, variant, block, bool_and(t is not null) as present,
  bool_and(coalesce(list_filter({_MARKS.format("source")}, lambda m: m in ('[!NOTE]', '[!TIP]', '[!IMPORTANT]', '[!WARNING]', '[!CAUTION]')) = {_MARKS.format("t")}, true)) as markers,
  bool_and(not coalesce(t is not null and length(source) >= 40 and (length(t) / length(source) < 0.22 or ({_SENTS.format("source")} >= 2 and {_SENTS.format("t")} * 2 < {_SENTS.format("source")})), false)) as whole
from r group by all
""",
    "gate_report": f"""
with r as ({ORACLE["gate_rates"]}),
c as (select candidate, sum(passed) filter (where variant = 'first') as a, sum(rows) filter (where variant = 'first') as b, sum(passed) filter (where variant = 'final') as c, sum(rows) filter (where variant = 'final') as d from r group by 1),
t as (select candidate, case when coalesce(b, 0) = 0 then '—' else format('{{:.1f}}% ({{}}/{{}})', a * 100.0 / b, a, b) end as first, case when coalesce(d, 0) = 0 then '—' else format('{{:.1f}}% ({{}}/{{}})', c * 100.0 / d, c, d) end as final from c)
select candidate, first, final, '| ' || coalesce(candidate, '') || ' | ' || first || ' | ' || final || ' |' as line from t
""",
    "viewer_pages": "select i.item, len(i.blocks)::int as blocks, count(distinct o.candidate)::int as candidates from eval_items i left join (select * from eval_outputs where repeat_no = 0) o using (item) group by i.item, i.blocks",
    "judging_plan": """
with p as (select distinct pick_id, baseline, candidate from judge_pairs), j as (select distinct judge, judge_model from judge_pairs where judge is not null and judge_model is not null)
select p.pick_id, p.baseline, p.candidate, j.judge, j.judge_model, o.shown_order from p cross join j cross join (select unnest(['AB', 'BA']) as shown_order) o
where not exists (select 1 from judge_pairs d where d.error is null and d.pick_id = p.pick_id and d.baseline = p.baseline and d.candidate = p.candidate and d.judge = j.judge and d.judge_model = j.judge_model and d.shown_order = o.shown_order)
""",
    "changed_translations": _CHANGED,
    "hard_items": f"with f as (select source, arg_max(struct_pack(m := mended, b := bad), feed_id) as f from ({_CHANGED}) group by 1) select item, block, pos, f.m as mended, f.b as bad from {_SEGS} s join f using (source)",
    "nontrivial_items": "select distinct item from " + _SEGS + " where not (length(source) < 20 or length(regexp_replace(regexp_replace(regexp_replace(source, '`[^`]*(`|$)', '', 'g'), '\\]\\([^)]*(\\)|$)', '', 'g'), '[^\\p{L}]', '', 'g')) < 12)",
}
ORACLE["judged_pairs"] = f"""
with n as (select list(candidate order by candidate) as n from (select distinct candidate from gate_rows)),
o as (select item, candidate, arg_max(map_entries(finals), out_id) as f from eval_outputs where repeat_no = 0 group by 1, 2),
t as (select item, candidate, array_to_string(list_transform(f, lambda e: e.value.translation), ' ') as t from o where f is not null),
p as (select x.item, x.t as a, y.t as b from t x join t y using (item), n where x.candidate = n.n[1] and y.candidate = n.n[2]),
r as (select item, 'AB' as shown_order, coalesce(a, '') as one, coalesce(b, '') as two, true as first from p union all select item, 'BA', coalesce(b, ''), coalesce(a, ''), false from p),
h as ({with_xxh64("(select *, one || two as _t from r)", "_t", "_h")}),
v as (select *, case when length(one) > length(two) then 'A' when length(two) > length(one) then 'B' when one = two then 'tie' when _h % 2 = 0 then 'A' else 'B' end as answer from h)
select item, shown_order, case when answer = 'tie' then 'tie' when (answer = 'A') = first then 'baseline' else 'candidate' end as overall, 1 as attempts from v
"""
# DuckDB's edit distance counts bytes, so that query has no SQL.
ORACLE = {k: v for k, v in ORACLE.items() if k != "segment_references"}
