"""Queries on segment states: identity, hashes, status, reconciliation, renames, batches, neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import columns as C
from weftline.functions import udfs as U
from weftline.operators import state as S
from weftline.operators import terms as M
from weftline.plans.sql_hash import with_pair_xxh64
from weftline.session import spread
from weftline.sources.tables import table


def _states(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return table(spark, folder, "segment_states", *columns)


def _latest(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return S.latest(_states(spark, folder, "path", "seg_id", "feed_id", *columns), ["path", "seg_id"], "feed_id")


def content_hash(spark: SparkSession, folder: str) -> DataFrame:
    """Computed from the text; must equal the stored hash."""
    rows = spread(_states(spark, folder, "feed_id", "source"), "feed_id")
    return rows.select("feed_id", U.content_hash("source").alias("source_hash"))


def segment_position(spark: SparkSession, folder: str) -> DataFrame:
    p = C.segment_position("seg_id")
    return _states(spark, folder, "feed_id", "seg_id").select("feed_id", p["section"].alias("section"), p["block"].alias("block"), p["seg"].alias("seg"), C.flat_index("seg_id").alias("flat_index"), C.block_id("seg_id").alias("block_id"))


def latest_segments(spark: SparkSession, folder: str) -> DataFrame:
    return _latest(spark, folder, "source_hash", "translated_at")


def segment_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """Hashes of the neighbours in the file, and whether the segment is its block's first."""
    rows = _latest(spark, folder, "source_hash").withColumn("at", C.flat_index("seg_id"))
    return S.neighbours(rows, "path", "at", "source_hash").select("path", "seg_id", "before_source_hash", "after_source_hash")


def context_hash(spark: SparkSession, folder: str) -> DataFrame:
    """The hash of both neighbours' hashes, of the latest state of each file."""
    rows = _latest(spark, folder, "source_hash").withColumn("at", C.flat_index("seg_id"))
    near = S.neighbours(rows, "path", "at", "source_hash")
    return near.select("path", "seg_id", U.context_hash(F.coalesce("before_source_hash", F.lit(0).cast(U.HASH)), F.coalesce("after_source_hash", F.lit(0).cast(U.HASH))).alias("context_hash"))


def _with_saved(spark: SparkSession, folder: str) -> DataFrame:
    """Each delivery beside the one before it of the same segment."""
    w = Window.partitionBy("path", "seg_id").orderBy("feed_id")
    cols = ("source_hash", "context_hash", "translation")
    rows = _states(spark, folder, "feed_id", "path", "seg_id", *cols)
    return rows.select("feed_id", "path", "seg_id", *cols, F.lag(F.struct(*cols)).over(w).alias("saved")).filter("saved is not null")


def _statuses(spark: SparkSession, folder: str) -> DataFrame:
    rows = _with_saved(spark, folder)
    state = S.status(F.col("saved.translation"), F.col("saved.source_hash"), F.col("source_hash"), F.col("saved.context_hash"), F.col("context_hash"))
    return rows.select("feed_id", "path", state.alias("status"))


def segment_status(spark: SparkSession, folder: str) -> DataFrame:
    return _statuses(spark, folder).select("feed_id", "status")


def status_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of each status by project, and over all projects (null)."""
    rows = _statuses(spark, folder).select(F.split("path", "/")[1].alias("project"), "status")
    return rows.groupingSets([["project", "status"], ["status"]], "project", "status").agg(F.count("*").alias("segments"))


def pending_segments(spark: SparkSession, folder: str) -> DataFrame:
    found = segment_status(spark, folder)
    return found.filter(S.needs_translation(F.col("status"))).select("feed_id", S.is_high_priority(F.col("status")).alias("high_priority"))


def _halves(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """A new parse (the latest delivery of each segment) and a saved state (the first delivery)."""
    rows = _states(spark, folder, "feed_id", "path", "seg_id", "source_hash")
    new = S.latest(rows, ["path", "seg_id"], "feed_id")
    old = rows.groupBy("path", "seg_id").agg(F.min_by("source_hash", "feed_id").alias("source_hash"))
    shape = lambda df: df.select(F.col("path").alias("file"), F.col("seg_id").alias("id"), F.col("source_hash").alias("hash"))
    return shape(new), shape(old)


def reconcile(spark: SparkSession, folder: str) -> DataFrame:
    return S.reconcile(*_halves(spark, folder)).select("file", "id", "saved_id")


def reconcile_report(spark: SparkSession, folder: str) -> DataFrame:
    return S.reconcile_counts(*_halves(spark, folder))


def rename_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """Files against the states of the first deliveries, read as orphans."""
    new, old = _halves(spark, folder)
    return S.renamed_files(new.select(F.col("file").alias("name"), "hash"), old.select(F.col("file").alias("name"), "hash"))


def rename_claims(spark: SparkSession, folder: str) -> DataFrame:
    return S.claim_orphans(rename_overlap(spark, folder))


def request_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks of each file in batches of at most 20 segments and 16 KiB."""
    rows = _latest(spark, folder, "source").withColumn("block", C.block_id("seg_id")).withColumn("at", C.flat_index("seg_id"))
    blocks = rows.groupBy("path", "block").agg(F.min("at").alias("at"), F.count("*").cast("int").alias("segments"), F.sum(F.octet_length("source")).cast("bigint").alias("bytes"))
    return S.batches(blocks, "path", ["at"], "bytes", 20, segments="segments").select("path", "block", "batch")


def batch_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return request_batches(spark, folder).groupBy("path").agg((F.max("batch") + 1).alias("batches"), F.count("*").alias("blocks"))


def block_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Each block's translation as it is written back: segments joined, an untranslated one falling back to its source; blocks without any translation are left out."""
    rows = _latest(spark, folder, "source", "translation").withColumn("block", C.block_id("seg_id")).withColumn("at", C.flat_index("seg_id"))
    parts = F.sort_array(F.collect_list(F.struct("at", F.coalesce("translation", "source").alias("t"))))
    found = rows.groupBy("path", "block").agg(F.count("translation").alias("n"), parts.alias("parts"))
    return found.filter("n > 0").select("path", "block", F.array_join(F.transform("parts", lambda p: p["t"]), " ").alias("text"))


def heading_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The source of the segment before and after, shortened, in document order."""
    rows = _latest(spark, folder, "source").withColumn("at", C.flat_index("seg_id")).withColumn("short", C.shorten("source", 60))
    return S.neighbours(rows, "path", "at", "short").select("path", "seg_id", "before_short", "after_short")


def restored_translations(spark: SparkSession, folder: str) -> DataFrame:
    """Latest rows without translation whose earlier delivery of the same source had one: the translation comes back."""
    rows = _states(spark, folder, "feed_id", "path", "seg_id", "source_hash", "translation")
    now = S.latest(rows, ["path", "seg_id"], "feed_id").filter("translation is null").drop("translation")
    earlier = rows.filter("translation is not null").groupBy("path", "seg_id", "source_hash").agg(F.max_by("translation", "feed_id").alias("translation"))
    return now.join(earlier, ["path", "seg_id", "source_hash"]).select("feed_id", "path", "seg_id", "translation")


def _prefixes(path: str) -> Column:
    """All folders that hold the path, the deepest first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def _rules(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "source_registry").filter("root is not null").groupBy("root").agg(F.min("project").alias("project"), F.min("skip_containing").alias("skip"))


def source_rules(spark: SparkSession, folder: str) -> DataFrame:
    """The registry rule of each file: the project with the deepest root above the path, unless the path holds what the rule skips."""
    files = _states(spark, folder, "path").distinct()
    # every folder above a path is looked up by an equi join, whatever the depth of the roots
    under = files.filter(F.contains("path", F.lit("/"))).select("path", F.posexplode(_prefixes("path")).alias("up", "root")).join(_rules(spark, folder), "root")
    hit = under.groupBy("path").agg(F.min_by(F.struct("project", "skip"), "up").alias("r"))
    return files.join(hit, "path", "left").filter(F.col("r.skip").isNull() | ~F.contains("path", "r.skip")).select("path", F.col("r.project").alias("project"))


def layer_overlay(spark: SparkSession, folder: str) -> DataFrame:
    """Deliveries as layers of one tree: the last layer of each path and segment wins, and says how many it covers."""
    rows = _states(spark, folder, "feed_id", "path", "seg_id", "source_hash")
    return rows.groupBy("path", "seg_id").agg(F.max("feed_id").alias("layer"), F.max_by("source_hash", "feed_id").alias("source_hash"), F.count("*").alias("layers"))


def orphan_states(spark: SparkSession, folder: str) -> DataFrame:
    """Files of states under no registered root."""
    files = _states(spark, folder, "path").distinct()
    held = files.filter(F.contains("path", F.lit("/"))).select("path", F.explode(_prefixes("path")).alias("root")).join(_rules(spark, folder), "root", "left_semi")
    return files.join(held.select("path"), "path", "left_anti")


def segment_headings(spark: SparkSession, folder: str) -> DataFrame:
    """The open headings of each segment, outermost first: section headings are the first block of their section."""
    rows = _latest(spark, folder, "source").select("path", "seg_id", "source", C.segment_position("seg_id").alias("p"))
    heads = rows.filter("p.block = 0").groupBy("path", F.col("p.section").alias("section")).agg(F.min_by(C.shorten("source", 120), F.col("p.seg")).alias("heading"))
    first = heads.groupBy("path").agg(F.min_by("heading", "section").alias("top"), F.min("section").alias("_first"))
    found = rows.withColumn("section", F.col("p.section")).join(heads, ["path", "section"], "left").join(first, "path", "left")
    stack = F.array_compact(F.array(F.when(F.col("section") != F.col("_first"), F.col("top")), F.col("heading")))
    return found.select("path", "seg_id", stack.alias("headings"))


def surroundings(spark: SparkSession, folder: str) -> DataFrame:
    """What a request shows around each pending segment: its headings, and the translated or else the source text before and after, shortened."""
    rows = _latest(spark, folder, "source", "translation").withColumn("at", C.flat_index("seg_id")).withColumn("shown", C.shorten(F.coalesce("translation", "source"), 80))
    near = S.neighbours(rows, "path", "at", "shown").filter("translation is null").select("path", "seg_id", "before_shown", "after_shown")
    return near.join(segment_headings(spark, folder), ["path", "seg_id"])


def request_plan(spark: SparkSession, folder: str) -> DataFrame:
    """What a run would ask for, without asking: pending segments, requests of at most 20 segments and 16 KiB, and bytes of each file."""
    rows = _latest(spark, folder, "source", "translation").filter("translation is null").withColumn("at", C.flat_index("seg_id")).withColumn("bytes", F.octet_length("source").cast("bigint"))
    found = S.batches(rows.select("path", "at", "bytes"), "path", ["at"], "bytes", 20)
    return found.groupBy("path").agg(F.count("*").alias("segments"), (F.max("batch") + 1).alias("requests"), F.sum("bytes").alias("bytes"))


def glossary_upserts(spark: SparkSession, folder: str) -> DataFrame:
    """Terms of the snapshots as changes to the glossary: the latest rendering of each term takes the place of the entry's."""
    snaps = _states(spark, folder, "feed_id", "glossary_snapshot").select("feed_id", F.explode("glossary_snapshot").alias("term", "translation")).groupBy(F.lower("term").alias("term")).agg(F.max_by("translation", F.struct("feed_id", "translation")).alias("translation"))
    entries = M.one_entry(table(spark, folder, "glossary"))
    return M.upsert(entries, snaps)


def glossary_removals(spark: SparkSession, folder: str) -> DataFrame:
    """The glossary without the terms that no segment's snapshot holds."""
    used = _states(spark, folder, "glossary_snapshot").select(F.explode(F.map_keys("glossary_snapshot")).alias("term")).select(F.lower("term").alias("term")).distinct()
    entries = M.one_entry(table(spark, folder, "glossary"))
    return M.delete(entries, entries.join(used, "term", "left_anti").select("term"))


def saved_states(spark: SparkSession, folder: str) -> DataFrame:
    """State files as they are written and read again: one JSON document a path with its segments in document order, published whole."""
    from weftline.session import scratch
    from weftline.sources import scan

    rows = _latest(spark, folder, "source_hash", "context_hash", "translation", "translated_at").withColumn("at", C.flat_index("seg_id"))
    target = scratch(spark)
    scan.write_states(rows, target, "path", "at")
    return scan.read_written_states(spark, target).groupBy("path").agg(F.count("*").alias("segments"), F.count("translation").alias("translated"), F.min_by("seg_id", "place").alias("first"), F.max_by("seg_id", "place").alias("last"))


def state_paths(spark: SparkSession, folder: str) -> DataFrame:
    """The sidecar that holds each file's state."""
    from weftline.sources import scan

    return _states(spark, folder, "path").distinct().select("path", scan.state_path("path").alias("state_path"))


def reconciled_status(spark: SparkSession, folder: str) -> DataFrame:
    """Statuses of each file's new segments after they were matched with the saved ones by hash and place; a segment without a match is pending."""
    rows = _states(spark, folder, "feed_id", "path", "seg_id", "source_hash", "context_hash", "translation")
    new = S.latest(rows.drop("translation"), ["path", "seg_id"], "feed_id").select(F.col("path").alias("file"), F.col("seg_id").alias("id"), F.col("source_hash").alias("now"), F.col("context_hash").alias("around"))
    old = rows.groupBy(F.col("path").alias("file"), F.col("seg_id").alias("saved_id")).agg(F.min_by(F.struct("source_hash", "context_hash", "translation"), "feed_id").alias("saved"))
    matched = S.reconcile(*_halves(spark, folder)).select("file", "id", "saved_id").join(new, ["file", "id"]).join(old, ["file", "saved_id"], "left")
    state = S.status(F.col("saved.translation"), F.col("saved.source_hash"), F.col("now"), F.col("saved.context_hash"), F.col("around"))
    return matched.groupBy("file", state.alias("status")).agg(F.count("*").alias("segments"))


def states_by_hash(spark: SparkSession, folder: str) -> DataFrame:
    """Segments of a file that hold one source: how many, and the first and last of them in the document."""
    rows = _latest(spark, folder, "source_hash").withColumn("at", C.flat_index("seg_id")).filter("source_hash is not null")
    return rows.groupBy("path", "source_hash").agg(F.count("*").alias("segments"), F.min_by("seg_id", "at").alias("first"), F.max_by("seg_id", "at").alias("last")).filter("segments > 1")


def adopted_renames(spark: SparkSession, folder: str) -> DataFrame:
    """Saved translations under the file that claims their orphaned state."""
    rows = _states(spark, folder, "feed_id", "path", "seg_id", "translation")
    old = rows.groupBy(F.col("path").alias("orphan"), "seg_id").agg(F.min_by("translation", "feed_id").alias("translation"))
    return old.filter("translation is not null").join(rename_claims(spark, folder).select("file", "orphan"), "orphan").select("file", "orphan", "seg_id", "translation")


def decided_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Terms that need no decision any more: those with a note stand for accepted ones, the others for rejected ones."""
    rows = table(spark, folder, "glossary", "term", "note")
    return M.decided(rows.filter("note is not null"), rows.filter("note is null"))


QUERIES = {f.__name__: f for f in (content_hash, segment_position, latest_segments, segment_neighbours, context_hash, segment_status, status_rollup, pending_segments, reconcile, reconcile_report, rename_overlap, rename_claims, request_batches, batch_sizes, block_texts, heading_neighbours, restored_translations, source_rules, layer_overlay, orphan_states, segment_headings, surroundings, request_plan, glossary_upserts, glossary_removals, saved_states, state_paths, reconciled_status, states_by_hash, adopted_renames, decided_terms)}

_LATEST = "(select * from segment_states qualify row_number() over (partition by path, seg_id order by feed_id desc) = 1)"
_AT = "(split_part(split_part(seg_id, '/', 1), ':', 2)::bigint * 1000000 + split_part(split_part(seg_id, '/', 2), ':', 2)::bigint * 1000 + split_part(split_part(seg_id, '/', 3), ':', 2)::bigint)"
_STATUS = """
select feed_id, path, case when st is null then 'Pending' when sh is distinct from source_hash then 'Stale' when sc is distinct from context_hash then 'ContextChanged' else 'Translated' end as status
from (select *, lag(translation) over w as st, lag(source_hash) over w as sh, lag(context_hash) over w as sc, lag(feed_id) over w as p
      from segment_states window w as (partition by path, seg_id order by feed_id)) where p is not null
"""
_OLD = "(select * from segment_states qualify row_number() over (partition by path, seg_id order by feed_id) = 1)"
_BLOCK = "regexp_replace(seg_id, '/seg:[^/]*$', '')"
_OVERLAP = f"""
with f as (select distinct path as file, source_hash as h from {_LATEST} where source_hash is not null),
o as (select distinct path as orphan, source_hash as h from {_OLD} where source_hash is not null),
n as (select file, count(*) as n from f group by file)
select file, orphan, count(*) as shared, count(*) / any_value(n.n) as score from f join o using (h) join n using (file)
group by file, orphan having count(*) / any_value(n.n) >= 0.5
"""

ORACLE = {
    "content_hash": "select feed_id, source_hash from segment_states",
    "segment_position": f"select feed_id, split_part(split_part(seg_id, '/', 1), ':', 2)::int as section, split_part(split_part(seg_id, '/', 2), ':', 2)::int as block, split_part(split_part(seg_id, '/', 3), ':', 2)::int as seg, {_AT} as flat_index, {_BLOCK} as block_id from segment_states",
    "latest_segments": f"select path, seg_id, feed_id, source_hash, translated_at from {_LATEST}",
    "segment_neighbours": f"select path, seg_id, lag(source_hash) over w as before_source_hash, lead(source_hash) over w as after_source_hash from {_LATEST} window w as (partition by path order by {_AT})",
    "segment_status": f"select feed_id, status from ({_STATUS})",
    "status_rollup": f"with s as ({_STATUS}) select split_part(path, '/', 2) as project, status, count(*) as segments from s group by 1, 2 union all select null, status, count(*) from s group by status",
    "pending_segments": f"select feed_id, status in ('Pending', 'Stale', 'GlossaryStale') as high_priority from ({_STATUS}) where status <> 'Translated'",
    "reconcile_report": f"""
with a as (select path as file, source_hash as h, count(*) as n from {_LATEST} group by 1, 2),
b as (select path as file, source_hash as h, count(*) as n from {_OLD} group by 1, 2),
m as (select coalesce(a.file, b.file) as file, coalesce(a.n, 0) as x, coalesce(b.n, 0) as y from a full join b on a.file = b.file and a.h = b.h)
select file, sum(least(x, y))::bigint as kept, sum(greatest(x - y, 0))::bigint as added, sum(greatest(y - x, 0))::bigint as dropped from m group by file
""",
    "rename_overlap": _OVERLAP,
    "block_texts": f"select path, {_BLOCK} as block, string_agg(coalesce(translation, source), ' ' order by {_AT}) as text from {_LATEST} group by 1, 2 having count(translation) > 0",
    "heading_neighbours": f"""
select path, seg_id, lag(short) over w as before_short, lead(short) over w as after_short
from (select *, case when length(t) <= 60 then t else substr(t, 1, 60) || '…' end as short from (select *, trim(regexp_replace(source, '\\s+', ' ', 'g')) as t from {_LATEST}))
window w as (partition by path order by {_AT})
""",
    "restored_translations": f"""
select n.feed_id, n.path, n.seg_id, e.translation from (select * from {_LATEST} where translation is null) n
join (select * from segment_states where translation is not null qualify row_number() over (partition by path, seg_id, source_hash order by feed_id desc) = 1) e
using (path, seg_id, source_hash)
""",
    "source_rules": """
with r as (select root, min(project) as project, min(skip_containing) as skip from source_registry where root is not null group by root)
select path, project from (select path, project, skip from (select distinct path from segment_states) s left join r on starts_with(s.path, r.root || '/') qualify row_number() over (partition by path order by length(root) desc nulls last) = 1)
where skip is null or not contains(path, skip)
""",
    "layer_overlay": "select path, seg_id, max(feed_id) as layer, arg_max(source_hash, feed_id) as source_hash, count(*) as layers from segment_states group by path, seg_id",
    "orphan_states": "select distinct path from segment_states s where not exists (select 1 from source_registry r where starts_with(s.path, r.root || '/'))",
}
_NEAR = f"(select path, seg_id, coalesce(lag(source_hash) over w, 0) as b, coalesce(lead(source_hash) over w, 0) as a from {_LATEST} window w as (partition by path order by {_AT}))"
_PAIRED = f"""
n as (select path as file, seg_id as id, source_hash as h, {_AT} as at, row_number() over (partition by path, source_hash order by {_AT}) as k from {_LATEST} where source_hash is not null),
o as (select path as file, source_hash as h, list(struct_pack(at := {_AT}, id := seg_id) order by {_AT}) as s from {_OLD} where source_hash is not null group by 1, 2)
"""
_PICK = "list_aggregate(list_transform(list_filter(range(1, len(o.s) + 1), lambda i: not list_contains({used}, i)), lambda i: struct_pack(d := abs(o.s[i].at - n.at), i := i)), 'min').i"
_BATCHED = """
b as (select path, block, segments, bytes, row_number() over (partition by path order by pos) as k from ({blocks})),
r as (select path, block, k, segments as total, bytes as weight, 0 as batch, bytes, segments from b where k = 1
  union all select b.path, b.block, b.k, case when f then b.segments else r.total + b.segments end, case when f then b.bytes else r.weight + 7 + b.bytes end, r.batch + f::int, b.bytes, b.segments
  from (select r.*, b.block as nb, r.total + b.segments > 20 or r.weight + 7 + b.bytes > 16384 as f from r join b on b.path = r.path and b.k = r.k + 1) r join b on b.path = r.path and b.k = r.k + 1)
"""
_BLOCK_ROWS = f"select path, {_BLOCK} as block, min({_AT}) as pos, count(*)::bigint as segments, sum(octet_length(encode(source)))::bigint as bytes from {_LATEST} group by 1, 2"
_PENDING_ROWS = f"select path, seg_id as block, {_AT} as pos, 1::bigint as segments, octet_length(encode(source))::bigint as bytes from {_LATEST} where translation is null"
_SHORT = "case when length({t}) <= {n} then {t} else substr({t}, 1, {n}) || '…' end"
_TRIM = "regexp_replace(regexp_replace({c}, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')"
_HEADINGS = f"""
(with r as (select path, seg_id, source, split_part(split_part(seg_id, '/', 1), ':', 2)::int as section, split_part(split_part(seg_id, '/', 2), ':', 2)::int as block, split_part(split_part(seg_id, '/', 3), ':', 2)::int as seg from {_LATEST}),
h as (select path, section, {_SHORT.format(t="t", n=120)} as heading from (select path, section, arg_min({_TRIM.format(c="source")}, seg) as t from r where block = 0 group by 1, 2)),
f as (select path, arg_min(heading, section) as top, min(section) as first from h group by 1)
select r.path, r.seg_id, list_filter([case when r.section <> f.first then f.top end, h.heading], lambda x: x is not null) as headings
from r left join h on h.path = r.path and h.section = r.section left join f on f.path = r.path)
"""
_ENTRIES = "(select lower(term) as term, min(struct_pack(translation := translation, kind := kind)) as m from glossary where term is not null group by 1)"
_SNAPS = "(select lower(e.key) as term, arg_max(e.value, struct_pack(f := feed_id, v := e.value)) as translation from (select feed_id, unnest(map_entries(glossary_snapshot)) as e from segment_states) group by 1)"
ORACLE |= {
    "context_hash": f"select path, seg_id, context_hash from ({with_pair_xxh64(_NEAR, 'b', 'a', 'context_hash')})",
    "reconcile": f"""
with recursive {_PAIRED},
r as (select n.file, n.h, n.k, n.id, {_PICK.format(used="[0]")} as c, [{_PICK.format(used="[0]")}] as used from n join o using (file, h) where n.k = 1
  union all select n.file, n.h, n.k, n.id, {_PICK.format(used="r.used")}, list_append(r.used, {_PICK.format(used="r.used")}) from r join n on n.file = r.file and n.h = r.h and n.k = r.k + 1 join o on o.file = n.file and o.h = n.h)
select l.path as file, l.seg_id as id, o.s[r.c].id as saved_id from {_LATEST} l left join r on r.file = l.path and r.id = l.seg_id left join o on o.file = r.file and o.h = r.h
""",
    "rename_claims": f"""
with recursive p as (select *, row_number() over (order by score desc, file, orphan) as k from ({_OVERLAP})),
r as (select k, file, orphan, score, true as taken, [file] as files, [orphan] as orphans from p where k = 1
  union all select p.k, p.file, p.orphan, p.score, not (list_contains(r.files, p.file) or list_contains(r.orphans, p.orphan)),
    case when list_contains(r.files, p.file) or list_contains(r.orphans, p.orphan) then r.files else list_append(r.files, p.file) end,
    case when list_contains(r.files, p.file) or list_contains(r.orphans, p.orphan) then r.orphans else list_append(r.orphans, p.orphan) end from r join p on p.k = r.k + 1)
select file, orphan, score from r where taken
""",
    "request_batches": f"with recursive {_BATCHED.format(blocks=_BLOCK_ROWS)} select path, block, batch from r",
    "batch_sizes": f"with recursive {_BATCHED.format(blocks=_BLOCK_ROWS)} select path, max(batch) + 1 as batches, count(*) as blocks from r group by path",
    "segment_headings": f"select * from {_HEADINGS}",
    "surroundings": f"""
with s as (select *, {_TRIM.format(c="coalesce(translation, source)")} as t from {_LATEST}),
n as (select path, seg_id, translation, lag({_SHORT.format(t="t", n=80)}) over w as before_shown, lead({_SHORT.format(t="t", n=80)}) over w as after_shown from s window w as (partition by path order by {_AT}))
select path, seg_id, before_shown, after_shown, headings from n join {_HEADINGS} using (path, seg_id) where translation is null
""",
    "request_plan": f"with recursive {_BATCHED.format(blocks=_PENDING_ROWS)} select path, count(*) as segments, max(batch) + 1 as requests, sum(bytes)::bigint as bytes from r group by path",
    "glossary_upserts": f"select coalesce(s.term, e.term) as term, coalesce(s.translation, e.m.translation) as translation, e.m.kind as kind from {_ENTRIES} e full join {_SNAPS} s on s.term = e.term",
    "glossary_removals": f"select term, m.translation as translation, m.kind as kind from {_ENTRIES} where term in (select term from {_SNAPS})",
    "saved_states": f"select path, count(*) as segments, count(translation) as translated, arg_min(seg_id, {_AT}) as first, arg_max(seg_id, {_AT}) as last from {_LATEST} group by path",
    "state_paths": "select distinct path, path || '.state.json' as state_path from segment_states",
}
ORACLE |= {
    "reconciled_status": f"""
with m as ({ORACLE["reconcile"]}), n as (select path as file, seg_id as id, source_hash as now, context_hash as around from {_LATEST}), o as (select path as file, seg_id as saved_id, source_hash as h, context_hash as c, translation as t from {_OLD}),
s as (select m.file, case when o.t is null then 'Pending' when o.h is distinct from n.now then 'Stale' when o.c is distinct from n.around then 'ContextChanged' else 'Translated' end as status
  from m join n using (file, id) left join o on o.file = m.file and o.saved_id = m.saved_id)
select file, status, count(*) as segments from s group by 1, 2
""",
    "states_by_hash": f"select path, source_hash, count(*) as segments, arg_min(seg_id, {_AT}) as first, arg_max(seg_id, {_AT}) as last from {_LATEST} where source_hash is not null group by 1, 2 having count(*) > 1",
    "adopted_renames": f"with c as ({ORACLE['rename_claims']}) select c.file, c.orphan, o.seg_id, o.translation from c join {_OLD} o on o.path = c.orphan where o.translation is not null",
    "decided_terms": "select distinct lower(term) as term from glossary where term is not null",
}
