"""Queries on texts: sentences, coverage, links, glossary, terms, quality checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import columns as C
from weftline.functions import glossary as G
from weftline.functions import text as X
from weftline.functions import udfs as U
from weftline.operators import coverage as V
from weftline.operators import tables as B
from weftline.operators import terms as M
from weftline.session import spread
from weftline.sources.parsers import parser_column
from weftline.sources.tables import table


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents", "doc_id", "text")


def segment_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that are not blank, with their hash and place."""
    return V.text_lines(_documents(spark, folder), "doc_id", "text").filter(C.trimmed("body") != "").select("doc_id", "line", F.md5("body").alias("hash"))


def sentences(spark: SparkSession, folder: str) -> DataFrame:
    rows = spread(_documents(spark, folder), "doc_id")
    return rows.select("doc_id", F.posexplode(U.sentences("text")).alias("sentence", "body"))


def sentence_counts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "segment_states", "feed_id", "source").select("feed_id", C.sentence_count("source").alias("sentences"))


def _fenced(spark: SparkSession, folder: str) -> DataFrame:
    lines = V.fenced(V.text_lines(_documents(spark, folder), "doc_id", "text"), "doc_id")
    return lines.withColumn("offered", ~F.col("code"))


def coverage_ratio(spark: SparkSession, folder: str) -> DataFrame:
    return V.coverage(_fenced(spark, folder), "doc_id", "offered")


def coverage_gaps(spark: SparkSession, folder: str) -> DataFrame:
    return V.gaps(_fenced(spark, folder), "doc_id", "offered")


def largest_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """The longest run of lines that no parser offers in each document, the first of equals."""
    gaps = coverage_gaps(spark, folder)
    return gaps.groupBy("doc_id").agg(F.min_by(F.struct("first_line", "lines"), F.struct(-F.col("lines"), F.col("first_line"))).alias("g")).select("doc_id", "g.first_line", "g.lines")


def coverage_report(spark: SparkSession, folder: str) -> DataFrame:
    """Coverage of all documents of a parser together, and how many of them are covered whole."""
    parsers = table(spark, folder, "documents", "doc_id", "parser")
    rows = coverage_ratio(spark, folder).join(parsers, "doc_id").groupBy("parser").agg(F.count("*").alias("documents"), F.count_if(F.col("ratio") == 1.0).alias("whole"), F.sum("word_lines").alias("word_lines"), F.sum("offered_lines").alias("offered_lines"))
    return rows.withColumn("ratio", F.round(F.coalesce(F.try_divide("offered_lines", "word_lines"), F.lit(1.0)), 9))


def links(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "translation_pairs", "pair_id", "source", "translation")
    return rows.select("pair_id", C.urls("source").alias("urls"), F.size(F.array_except(C.urls("source"), F.coalesce(C.urls("translation"), F.array()))).alias("lost")).filter(F.size("urls") > 0)


def alert_markers(spark: SparkSession, folder: str) -> DataFrame:
    """Markers of both sides; they agree if the lists are equal."""
    rows = table(spark, folder, "raw_blocks", "raw_id", "source", "translation").filter("translation is not null")
    a, b = C.alert_markers("source"), C.alert_markers("translation")
    return rows.select("raw_id", F.size(a).alias("ours"), F.size(b).alias("theirs"), (a == b).alias("agree"))


def truncation_gate(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "segment_states", "feed_id", "source", "translation").filter("translation is not null")
    return rows.filter(C.truncated("source", "translation", 0.22)).select("feed_id")


def trivial_segments(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "segment_states", "feed_id", "source")
    return rows.select("feed_id", C.prose_letters("source").alias("letters"), C.trivial("source").alias("trivial"))


def display_widths(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "translation_pairs", "pair_id", "translation").select("pair_id", C.display_width("translation").alias("width"))


def code_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Code spans of the source that the translation lacks, with multiplicity."""
    rows = table(spark, folder, "segment_states", "feed_id", "source", "translation").filter("translation is not null")
    span = lambda c: F.regexp_extract_all(c, F.lit("`([^`]+)`"), 1)
    return rows.select("feed_id", F.size(span("source")).alias("spans"), (~C.is_multiset_subset(span("source"), span("translation"))).alias("lost"))


def code_differences(spark: SparkSession, folder: str) -> DataFrame:
    """Code spans that the translation lacks and that it has besides, with multiplicity and in their order."""
    rows = table(spark, folder, "segment_states", "feed_id", "source", "translation").filter("translation is not null")
    span = lambda c: F.regexp_extract_all(c, F.lit("`([^`]+)`"), 1)
    found = rows.select("feed_id", C.multiset_difference(span("source"), span("translation")).alias("lost"), C.multiset_difference(span("translation"), span("source")).alias("new"))
    return found.filter((F.size("lost") > 0) | (F.size("new") > 0)).select("feed_id", F.array_join("lost", " ").alias("lost"), F.array_join("new", " ").alias("new"))


def heading_slugs(spark: SparkSession, folder: str) -> DataFrame:
    """Anchors of the first block of each section."""
    rows = table(spark, folder, "segment_states", "feed_id", "seg_id", "source").filter(C.segment_position("seg_id")["block"] == 0)
    return rows.select("feed_id", C.heading_slug("source").alias("slug"))


def markup_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """References, definitions, formulas and tokens of raw blocks by kind."""
    rows = spread(table(spark, folder, "raw_blocks", "raw_id", "source"), "raw_id")
    return rows.select("raw_id", F.explode(U.token_counts("source")).alias("kind", "n"))


def off_register(spark: SparkSession, folder: str) -> DataFrame:
    rows = spread(table(spark, folder, "segment_states", "feed_id", "source", "translation"), "feed_id").filter(r"translation is not null and source rlike '\\.\\s*$'")
    return rows.select("feed_id", F.explode(U.off_register("translation")).alias("ending"))


# --- glossary


def _entries(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "glossary")


def glossary_entries(spark: SparkSession, folder: str) -> DataFrame:
    return M.one_entry(_entries(spark, folder))


def glossary_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Curated entries are those with a note; the rest counts as generated."""
    rows = _entries(spark, folder).select("term", "translation", "note")
    return M.merge_glossaries(rows.filter("note is not null").distinct(), rows.filter("note is null").distinct())


def glossary_usage(spark: SparkSession, folder: str) -> DataFrame:
    return M.used_terms(table(spark, folder, "segment_states", "feed_id", "source"), _entries(spark, folder), "feed_id", "source").groupBy("term").agg(F.count("*").alias("segments"))


def _glossary(spark: SparkSession, folder: str) -> G.Glossary:
    """The glossary for the tasks: terms, the phrases in which they are ordinary words, and whole-segment entries. A glossary too large to send raises."""
    entries = _entries(spark, folder).filter("term is not null")
    rows = M.one_entry(entries).limit(G.MOST_TERMS + 1).collect()
    excepts = entries.select(F.lower("term").alias("t"), F.explode("excepts").alias("e")).distinct().limit(G.MOST_TERMS + 1).collect()
    if len(rows) > G.MOST_TERMS or len(excepts) > G.MOST_TERMS:
        raise ValueError(f"a glossary of more than {G.MOST_TERMS} entries must be joined, not sent")
    by: dict[str, list[str]] = {}
    for r in excepts:
        by.setdefault(r["t"], []).append(r["e"])
    known = [r for r in rows if r["translation"] is not None]
    whole = {X.normalize_whole(r["term"]): (r["term"], r["translation"]) for r in known if r["kind"] == "whole"}
    return G.Glossary({r["term"]: r["translation"] for r in known if r["kind"] != "whole"}, by, whole)


def glossary_unmet(spark: SparkSession, folder: str) -> DataFrame:
    """Terms used as prose whose rendering the translation lacks, by the full matching rules."""
    glossary = _glossary(spark, folder)
    rows = spread(table(spark, folder, "segment_states", "feed_id", "source", "translation"), "feed_id").filter("translation is not null")
    used = rows.select("feed_id", "translation", F.explode(U.glossary_terms(glossary)("source")).alias("term", "rendering"))
    return used.filter(~F.contains(F.lower("translation"), F.lower("rendering"))).select("feed_id", "term", "rendering")


def glossary_stale(spark: SparkSession, folder: str) -> DataFrame:
    """Segments whose snapshot renders a used term otherwise than the glossary does now."""
    glossary = _glossary(spark, folder)
    rows = spread(table(spark, folder, "segment_states", "feed_id", "source", "glossary_snapshot"), "feed_id")
    from weftline.operators.state import snapshot_stale

    return rows.withColumn("used", U.glossary_terms(glossary)("source")).filter(snapshot_stale(F.col("glossary_snapshot"), F.col("used"))).select("feed_id")


def adopted_states(spark: SparkSession, folder: str) -> DataFrame:
    """Translated states with a stale snapshot or a glossary issue, and what becomes of them."""
    from weftline.operators import adoption

    rows = spread(table(spark, folder, "segment_states", "feed_id", "source", "translation", "glossary_snapshot", "issues"), "feed_id")
    return adoption.adopt(rows, _glossary(spark, folder), ["feed_id"])


def adoption_summary(spark: SparkSession, folder: str) -> DataFrame:
    from weftline.operators import adoption

    return adoption.summary(adopted_states(spark, folder))


def screened_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Recurring words of the sources, screened in batches by a deterministic model that picks those of 100 occurrences and more."""
    from weftline.operators import models

    terms = bigram_counts(spark, folder).select(F.col("ngram").alias("term"), "n")
    return models.screen_terms(terms, lambda: models.ScreeningProvider(100))


def _grams(spark: SparkSession, folder: str) -> DataFrame:
    return M.ngrams(spread(table(spark, folder, "segment_states", "feed_id", "source"), "feed_id"), "feed_id", "source")


def ngram_top(spark: SparkSession, folder: str) -> DataFrame:
    """The 2,000 commonest terms: counted, plurals folded, covered ones dropped."""
    return M.top(M.open_ngrams(M.fold_plurals(M.counts(_grams(spark, folder))).filter("n >= 4")), 2000)


def ngram_spellings(spark: SparkSession, folder: str) -> DataFrame:
    return M.usual_spelling(_grams(spark, folder))


def word_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Words of all documents in lower case, and how many documents hold each."""
    words = _documents(spark, folder).select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1)).alias("word"))
    return words.groupBy("word", "doc_id").agg(F.count("*").alias("c")).groupBy("word").agg(F.sum("c").alias("n"), F.count("*").alias("documents"))


def bigram_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Adjacent words of segment sources, by plain splitting, counted."""
    w = table(spark, folder, "segment_states", "source").select(F.regexp_extract_all(F.lower("source"), F.lit(r"(\p{L}+)"), 1).alias("w")).filter(F.size("w") >= 2)
    pairs = w.select(F.explode(F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1), lambda a, b: F.concat(a, F.lit(" "), b))).alias("ngram"))
    return M.counts(pairs, 4)


def whole_variants(spark: SparkSession, folder: str) -> DataFrame:
    return M.whole_variants(table(spark, folder, "segment_states", "source", "translation"), "source", "translation")


def known_projects(spark: SparkSession, folder: str) -> DataFrame:
    """Set operations on project names: in documents and registered, and which side lacks one."""
    a = table(spark, folder, "documents", "source").select(F.col("source").alias("project")).filter("project is not null").distinct()
    b = table(spark, folder, "source_registry", "project").filter("project is not null").distinct()
    kind = lambda df, k: df.withColumn("kind", F.lit(k))
    return kind(a.intersect(b), "both").unionByName(kind(a.exceptAll(b), "documents")).unionByName(kind(b.exceptAll(a), "registry"))


def _translated(spark: SparkSession, folder: str) -> DataFrame:
    rows = spread(table(spark, folder, "segment_states", "feed_id", "path", "source", "translation"), "feed_id").filter("translation is not null")
    return rows.withColumn("markup", parser_column(F.col("path")))


def quality_issues(spark: SparkSession, folder: str) -> DataFrame:
    """Issues of every translated segment against its source, by the rules of its file's markup."""
    return _translated(spark, folder).select("feed_id", F.explode(U.quality_issues("source", "translation", "markup")).alias("issue"))


def quality_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of each candidate without an issue."""
    rows = spread(table(spark, folder, "translation_pairs", "pair_id", "candidate", "source", "translation"), "pair_id")
    found = rows.withColumn("issues", F.size(F.coalesce(U.quality_issues("source", "translation", F.lit("markdown")), F.array(F.lit("missing")))))
    return found.groupBy("candidate").agg(F.count("*").alias("pairs"), F.count_if(F.col("issues") == 0).alias("passed"))


def repaired_translations(spark: SparkSession, folder: str) -> DataFrame:
    """Translations that the repairs of their markup change, as they are after it."""
    rows = _translated(spark, folder).withColumn("repaired", U.repaired("source", "translation", "markup"))
    return rows.filter(F.col("repaired") != F.col("translation")).select("feed_id", "markup", "repaired")


def inline_audits(spark: SparkSession, folder: str) -> DataFrame:
    """How the inline markup of the translations stands, by markup: sound, repaired, or beyond repair."""
    found = _translated(spark, folder).select("markup", U.audited("source", "translation", "markup")["outcome"].alias("outcome"))
    return found.groupBy("markup", "outcome").agg(F.count("*").alias("segments"))


def xml_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each document of an XML markup is itself again after its elements were turned into tags and back."""
    rows = spread(table(spark, folder, "documents", "doc_id", "text", "parser").filter("parser = 'xhtml' and text is not null"), "doc_id")
    return rows.select("doc_id", U.xml_tags("text")["same"].alias("same"))


def inline_tags(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks with their inline markup as numbered tags."""
    rows = spread(table(spark, folder, "raw_blocks", "raw_id", "source"), "raw_id")
    return rows.select("raw_id", U.tagged("source").alias("tagged"))


def inline_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each block is itself again after its markup was turned into tags and back."""
    rows = spread(table(spark, folder, "raw_blocks", "raw_id", "source"), "raw_id")
    return rows.select("raw_id", U.tags_come_back("source").alias("same"))


def table_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Cells of pipe tables, with the second column's numbers left out by a rule on the header."""
    cells = B.pipe_tables(table(spark, folder, "raw_blocks", "raw_id", "source"), "raw_id", "source")
    return B.apply_rules(cells, ["raw_id", "table_no"], [{"headerless": True, "skip": ["0"]}, {"headers": [], "skip": ["1"]}])


def table_headers(spark: SparkSession, folder: str) -> DataFrame:
    cells = B.pipe_tables(table(spark, folder, "raw_blocks", "raw_id", "source"), "raw_id", "source")
    return B.table_groups(cells, ["raw_id", "table_no"])


QUERIES = {f.__name__: f for f in (segment_lines, sentences, sentence_counts, coverage_ratio, coverage_gaps, largest_gaps, coverage_report, links, alert_markers, truncation_gate, trivial_segments, display_widths, code_spans, code_differences, heading_slugs, markup_tokens, off_register, glossary_entries, glossary_merge, glossary_usage, glossary_unmet, glossary_stale, adopted_states, adoption_summary, screened_terms, ngram_top, ngram_spellings, word_counts, bigram_counts, whole_variants, known_projects, quality_issues, quality_rates, repaired_translations, inline_audits, xml_round_trip, inline_tags, inline_round_trip, table_cells, table_headers)}

_LINES = "(select doc_id, unnest(string_split(text, chr(10))) as body, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line from documents where text is not null)"
_FENCED = f"""
(select *, f or n % 2 = 1 as code from (
  select *, sum(f::int) over (partition by doc_id order by line rows unbounded preceding) as n
  from (select *, regexp_matches(body, '^\\s{{0,3}}(```|~~~)') as f from {_LINES})))
"""
_SENT = "greatest(1, len(regexp_extract_all({0} || ' ', '(?:^|[^0-9.?!。])[.?!。]\\s|[^0-9][.?!。]\\s')))"
_PROSE = "length(regexp_replace(regexp_replace(regexp_replace({0}, '`[^`]*(`|$)', '', 'g'), '\\]\\([^)]*(\\)|$)', '', 'g'), '[^\\p{{L}}]', '', 'g'))"

_CELLS = """
(with l as (select raw_id, unnest(string_split(source, chr(10))) as body, generate_subscripts(string_split(source, chr(10)), 1) as line from raw_blocks),
b as (select *, regexp_matches(body, '^\\s*\\|') as t, coalesce(lag(regexp_matches(body, '^\\s*\\|')) over (partition by raw_id order by line), false) as p from l),
n as (select *, sum((t and not p)::int) over (partition by raw_id order by line rows unbounded preceding)::int as table_no from b),
r as (select raw_id, table_no, body, (row_number() over (partition by raw_id, table_no order by line) - 1)::int as table_row from n
  where t and not regexp_matches(body, '^\\s*\\|?\\s*:?-+:?\\s*(\\|\\s*:?-+:?\\s*)*\\|?\\s*$')),
c as (select raw_id, table_no, table_row, string_split(regexp_replace(regexp_replace(body, '^\\s*\\|', ''), '\\|\\s*$', ''), '|') as cells from r)
select raw_id, table_no, table_row, (generate_subscripts(cells, 1) - 1)::int as column, trim(unnest(cells), ' ') as text, table_row = 0 as label_row from c)
"""

ORACLE = {
    "xml_round_trip": "select doc_id, true as same from documents where parser = 'xhtml' and text is not null",
    "inline_round_trip": "select raw_id, case when source is not null then true end as same from raw_blocks",
    "table_cells": f"select raw_id, table_no, table_row, \"column\", text, label_row, label_row or \"column\" <> 1 as offered from {_CELLS}",
    "table_headers": f"select raw_id, table_no, list(text order by \"column\") filter (where label_row) as headers, max(\"column\") + 1 as columns, max(table_row) + 1 as rows from {_CELLS} group by 1, 2",
    "segment_lines": f"select doc_id, line::int as line, md5(body) as hash from {_LINES} where regexp_replace(body, '^\\s+|\\s+$', '', 'g') <> ''",
    "sentence_counts": f"select feed_id, {_SENT.format('source')}::int as sentences from segment_states",
    "coverage_ratio": f"""
select doc_id, word_lines, offered_lines, case when word_lines = 0 then 1.0 else offered_lines / word_lines end as ratio from (
  select doc_id, count(*) filter (where w) as word_lines, count(*) filter (where w and not code) as offered_lines
  from (select *, regexp_matches(body, '[\\p{{L}}\\p{{N}}]') as w from {_FENCED}) group by doc_id)
""",
    "coverage_gaps": f"""
select doc_id, min(line)::int as first_line, max(line)::int as last_line, count(*) as lines from (
  select *, sum((not code)::int) over (partition by doc_id order by line rows unbounded preceding) as g from {_FENCED})
where code and regexp_matches(body, '[\\p{{L}}\\p{{N}}]') group by doc_id, g
""",
    "links": """
with u as (select pair_id, list_transform(regexp_extract_all(source, 'https?://[^\\s<>"`}\\]()]+'), lambda x: regexp_replace(x, '[.,;:\\\\]+$', '')) as a,
  list_transform(regexp_extract_all(coalesce(translation, ''), 'https?://[^\\s<>"`}\\]()]+'), lambda x: regexp_replace(x, '[.,;:\\\\]+$', '')) as b from translation_pairs)
select pair_id, a as urls, len(list_filter(list_distinct(a), lambda x: not list_contains(b, x)))::int as lost from u where len(a) > 0
""",
    "alert_markers": """
with m as (select raw_id, list_sort(regexp_extract_all(source, '\\[![^\\]]*\\]?')) as a, list_sort(regexp_extract_all(translation, '\\[![^\\]]*\\]?')) as b from raw_blocks where translation is not null)
select raw_id, len(a)::int as ours, len(b)::int as theirs, a = b as agree from m
""",
    "truncation_gate": f"""
select feed_id from (select feed_id, source, translation, {_SENT.format('source')} as a, {_SENT.format('translation')} as b from segment_states where translation is not null)
where length(source) >= 40 and (length(translation) / length(source) < 0.22 or (a >= 2 and b * 2 < a))
""",
    "trivial_segments": f"select feed_id, ({_PROSE.format('source')})::int as letters, length(source) < 20 or {_PROSE.format('source')} < 12 as trivial from segment_states",
    "display_widths": "select pair_id, (length(translation) + length(regexp_replace(translation, '[^\\x{1100}-\\x{115F}\\x{2E80}-\\x{303E}\\x{3041}-\\x{33FF}\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{A000}-\\x{A4CF}\\x{AC00}-\\x{D7A3}\\x{F900}-\\x{FAFF}\\x{FE30}-\\x{FE4F}\\x{FF00}-\\x{FF60}\\x{FFE0}-\\x{FFE6}\\x{20000}-\\x{2FFFD}\\x{30000}-\\x{3FFFD}]', '', 'g')))::int as width from translation_pairs",
    "code_spans": """
with s as (select feed_id, regexp_extract_all(source, '`([^`]+)`', 1) as a, regexp_extract_all(translation, '`([^`]+)`', 1) as b from segment_states where translation is not null)
select feed_id, len(a)::int as spans, len(list_filter(list_distinct(a), lambda x: len(list_filter(a, lambda y: y = x)) > len(list_filter(b, lambda y: y = x)))) > 0 as lost from s
""",
    "glossary_entries": "select term, m.translation as translation, m.kind as kind from (select lower(term) as term, min(struct_pack(translation := translation, kind := kind)) as m from glossary where term is not null group by 1)",
    "glossary_merge": "with c as (select distinct term, translation, note from glossary where note is not null and term is not null), g as (select distinct term, translation, note from glossary where note is null and term is not null) select * from c union all select * from g where lower(term) not in (select lower(term) from c)",
    "glossary_usage": """
with t as (select distinct lower(term) as term from glossary where term is not null),
s as (select feed_id, ' ' || regexp_replace(lower(source), '[^\\p{L}\\p{N}]+', ' ', 'g') || ' ' as w from segment_states)
select term, count(*) as segments from s join t on contains(w, ' ' || regexp_replace(term, '[^\\p{L}\\p{N}]+', ' ', 'g') || ' ') group by term
""",
    "word_counts": "select word, count(*) as n, count(distinct doc_id) as documents from (select doc_id, unnest(regexp_extract_all(lower(text), '\\p{L}+')) as word from documents) group by word",
    "bigram_counts": """
with w as (select row_number() over () as r, regexp_extract_all(lower(source), '\\p{L}+') as w from segment_states),
p as (select unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as ngram from w where len(w) >= 2)
select ngram, count(*) as n from p group by ngram having count(*) >= 4
""",
    "whole_variants": """
with t as (select *, regexp_replace(source, '^\\s+|\\s+$', '', 'g') as t from segment_states),
s as (select regexp_replace(regexp_replace(source, '^[*_\\s]+', ''), '[*_\\s:.：]+$', '') as a, regexp_replace(regexp_replace(translation, '^[*_\\s]+', ''), '[*_\\s:.：]+$', '') as b from t
  where len(string_split_regex(t, '\\s+')) <= 6 and length(t) <= 80 and regexp_matches(regexp_replace(t, '^[^\\p{L}\\p{N}]+', ''), '^\\p{Lu}') and not regexp_matches(t, ',$')),
v as (select lower(a) as term, lower(b) as variant, count(*) as c from s group by 1, 2)
select term, sum(c)::bigint as n, list(variant order by c desc, variant) filter (where variant is not null) as variants from v where term <> '' group by term having sum(c) >= 3 and count(variant) >= 2
""",
    "known_projects": """
with a as (select distinct source as project from documents where source is not null), b as (select distinct project from source_registry where project is not null)
select project, 'both' as kind from a where project in (select project from b)
union all select project, 'documents' from a where project not in (select project from b)
union all select project, 'registry' from b where project not in (select project from a)
""",
}
ORACLE["screened_terms"] = f"select ngram as term, n >= 100 as picked from ({ORACLE['bigram_counts']})"
ORACLE["off_register"] = """
with t as (select feed_id, regexp_extract(unnest(string_split(translation, '.')), '[가-힣]+$') as t from segment_states where translation is not null and regexp_matches(source, '\\.\\s*$'))
select feed_id, '…' || right(t, 6) || '.' as ending from t where t <> '' and (regexp_matches(t, '(세요|어요|아요|해요|예요|에요|네요|지요|죠)$')
  or (t like '%다' and not (t like '%니다' or t like '%읍시다' or (t like '%시다' and length(t) > 2 and (unicode(substr(t, -3, 1)) - 44032) % 28 = 17))))
"""
ORACLE["code_differences"] = """
with s as (select feed_id, regexp_extract_all(source, '`([^`]+)`', 1) as a, regexp_extract_all(translation, '`([^`]+)`', 1) as b from segment_states where translation is not null),
d as (select feed_id,
  list_transform(list_filter(range(1, len(a) + 1), lambda i: len(list_filter(a[1:i], lambda x: x = a[i])) > len(list_filter(b, lambda x: x = a[i]))), lambda i: a[i]) as lost,
  list_transform(list_filter(range(1, len(b) + 1), lambda i: len(list_filter(b[1:i], lambda x: x = b[i])) > len(list_filter(a, lambda x: x = b[i]))), lambda i: b[i]) as new from s)
select feed_id, array_to_string(lost, ' ') as lost, array_to_string(new, ' ') as new from d where len(lost) > 0 or len(new) > 0
"""
ORACLE["heading_slugs"] = "select feed_id, nullif(array_to_string(regexp_extract_all(lower(source), '[a-z0-9]+'), '-'), '') as slug from segment_states where split_part(seg_id, '/', 2) = 'block:0'"
ORACLE["largest_gaps"] = f"select doc_id, first_line, lines from ({ORACLE['coverage_gaps']}) qualify row_number() over (partition by doc_id order by lines desc, first_line) = 1"
ORACLE["coverage_report"] = f"""
select parser, count(*) as documents, count(*) filter (where ratio = 1.0) as whole, sum(word_lines)::bigint as word_lines, sum(offered_lines)::bigint as offered_lines, round(case when sum(word_lines) = 0 then 1.0 else sum(offered_lines) / sum(word_lines) end, 9) as ratio
from ({ORACLE["coverage_ratio"]}) join documents using (doc_id) group by parser
"""
