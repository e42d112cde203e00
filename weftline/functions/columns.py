"""Column versions of the text functions: built-in expressions that stay in the JVM and in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def segment_position(segment_id: Column | str) -> Column:
    """STRUCT<section, block, seg> of 'section:S/block:B/seg:N'; null for any other text."""
    c = _c(segment_id)
    part = lambda k: F.regexp_extract(c, r"^section:(\d+)/block:(\d+)/seg:(\d+)$", k).cast("int")
    return F.when(c.rlike(r"^section:\d+/block:\d+/seg:\d+$"), F.struct(part(1).alias("section"), part(2).alias("block"), part(3).alias("seg")))


def flat_index(segment_id: Column | str) -> Column:
    """section * 10^6 + block * 10^3 + seg."""
    p = segment_position(segment_id)
    return p["section"].cast("bigint") * 1_000_000 + p["block"].cast("bigint") * 1000 + p["seg"]


def block_id(segment_id: Column | str) -> Column:
    return F.regexp_replace(_c(segment_id), r"/seg:[^/]*$", "")


def trimmed(text: Column | str) -> Column:
    """Without white space of any kind at both ends; the built-in trim only removes spaces."""
    return F.regexp_replace(_c(text), r"^\s+|\s+$", "")


def normalize_whole(text: Column | str) -> Column:
    """Key under which whole segments are compared."""
    return F.lower(F.regexp_replace(F.regexp_replace(_c(text), r"^[*_\s]+", ""), r"[*_\s:.：]+$", ""))


def sentence_count(text: Column | str) -> Column:
    return F.greatest(F.lit(1), F.regexp_count(_c(text), F.lit(r"(?<![0-9])[.?!。](?=\s|$)")))


def length_ratio(source: Column | str, translation: Column | str) -> Column:
    return F.try_divide(F.length(_c(translation)), F.length(_c(source)))


def truncated(source: Column | str, translation: Column | str, least: float) -> Column:
    """Whether a text looks cut against its source; false for sources under 40 characters, null for null texts."""
    s, t = _c(source), _c(translation)
    short = length_ratio(s, t) < F.lit(least)
    few = (sentence_count(s) >= 2) & (sentence_count(t) * 2 < sentence_count(s))
    return F.when(s.isNull() | t.isNull(), F.lit(None).cast("boolean")).otherwise((F.length(s) >= 40) & (short | few))


def alert_markers(text: Column | str) -> Column:
    return F.sort_array(F.regexp_extract_all(_c(text), F.lit(r"(\[![^\]]*\]?)"), 1))


def urls(text: Column | str) -> Column:
    """Addresses without parentheses; the scanner in text.py balances those."""
    return F.transform(F.regexp_extract_all(_c(text), F.lit(r"(https?://[^\s<>\"`}\]()]+)"), 1), lambda u: F.regexp_replace(u, r"[.,;:\\]+$", ""))


def prose_letters(text: Column | str) -> Column:
    bare = F.regexp_replace(_c(text), r"`[^`]*(`|$)", "")
    return F.length(F.regexp_replace(F.regexp_replace(bare, r"\]\([^)]*(\)|$)", ""), r"[^\p{L}]", ""))


def trivial(text: Column | str) -> Column:
    return (F.length(_c(text)) < 20) | (prose_letters(text) < 12)


def shorten(text: Column | str, limit: int = 300) -> Column:
    flat = trimmed(F.regexp_replace(_c(text), r"\s+", " "))
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.substring(flat, 1, limit), F.lit("…")))


def display_width(text: Column | str) -> Column:
    wide = "[^\\u1100-\\u115F\\u2E80-\\u303E\\u3041-\\u33FF\\u3400-\\u4DBF\\u4E00-\\u9FFF\\uA000-\\uA4CF\\uAC00-\\uD7A3\\uF900-\\uFAFF\\uFE30-\\uFE4F\\uFF00-\\uFF60\\uFFE0-\\uFFE6\\x{20000}-\\x{2FFFD}\\x{30000}-\\x{3FFFD}]"
    return F.length(_c(text)) + F.length(F.regexp_replace(_c(text), wide, ""))


def answer_side(answer: Column | str, baseline_first: Column | str) -> Column:
    """Which side an answer A or B names; anything else is a tie."""
    a, first = F.upper(trimmed(answer)), _c(baseline_first)
    return F.when(a == "A", F.when(first, "baseline").otherwise("candidate")).when(a == "B", F.when(first, "candidate").otherwise("baseline")).otherwise("tie")


def strata(raw: Column | str, sources: Column | str, tags: Column | int = 0) -> Column:
    """Tags of a block: long, inline-markup, math, list, table, heading, trivial, prose. raw null counts as empty; sources is the array of its segments' texts."""
    text, items = F.coalesce(_c(raw), F.lit("")), F.coalesce(_c(sources), F.array())
    head = F.regexp_replace(text, r"^\s+", "")
    count = lambda part: F.regexp_count(text, F.lit(part))
    marks = count("`") + count(r"\]\(") + count(r"\*\*")
    starts = lambda *p: F.lit(False) if not p else F.expr("false") | _any([head.startswith(x) for x in p])
    found = F.array_compact(
        F.array(
            F.when(F.size(items) >= 4, "long"),
            F.when((F.lit(tags) >= 3 if isinstance(tags, int) else tags >= 3) | (marks >= 4), "inline-markup"),
            F.when(text.contains("$") | text.contains("\\(") | text.contains(":math:") | text.contains("\\begin{equation"), "math"),
            F.when(starts("- ", "* ", "\\item"), "list"),
            F.when(starts("|"), "table"),
            F.when(starts("#", "\\section", "\\chapter"), "heading"),
            F.when(F.forall(items, lambda s: trivial(F.coalesce(s, F.lit("")))), "trivial"),
        )
    )
    plain = (F.size(found) == 0) | ((F.size(found) == 1) & (F.element_at(found, 1) == "long"))
    return F.when((F.size(found) == 0), F.array(F.lit("prose"))).when(plain, F.array_append(found, "prose")).otherwise(found)


def _any(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out | c
    return out


def matches_headers(wanted: list[str], headers: Column | str) -> Column:
    """Whether `wanted` is a subsequence of the header array, without regard to case; an empty list matches anything."""
    low = F.transform(_c(headers), lambda h: F.lower(h))
    n = len(wanted)
    names = F.array(*(F.lit(w.lower()) for w in wanted)) if wanted else F.array().cast("array<string>")
    return F.aggregate(low, F.lit(0), lambda at, h: F.when((at < n) & (F.get(names, at) == h), at + 1).otherwise(at)) == n


def keeps_column(index: Column, header: Column, translate: list[str], skip: list[str]) -> Column:
    """Whether a table column is offered: the translate list decides, or what is not in skip; names in any case or 0-based numbers."""
    among = lambda names: _any([F.lower(header) == n.lower() if not n.isdigit() else index == int(n) for n in names])
    return F.coalesce(among(translate), F.lit(False)) if translate else ~F.coalesce(among(skip), F.lit(False)) if skip else F.lit(True)


def multiset_difference(a: Column | str, b: Column | str) -> Column:
    """a without b, with multiplicity, in the order of a: of equal items the last ones stay."""
    x, y = F.coalesce(_c(a), F.array()), F.coalesce(_c(b), F.array())
    place = F.transform(x, lambda v, i: F.struct(v.alias("v"), F.size(F.filter(F.slice(x, F.lit(1), i + 1), lambda w: w == v)).alias("nth")))
    return F.transform(F.filter(place, lambda p: p["nth"] > F.size(F.filter(y, lambda w: w == p["v"]))), lambda p: p["v"])


def heading_slug(text: Column | str) -> Column:
    """Words of letters a-z and digits in lower case, joined by hyphens; null if there are none."""
    return F.nullif(F.array_join(F.regexp_extract_all(F.lower(_c(text)), F.lit("([a-z0-9]+)"), 1), "-"), F.lit(""))


def multiset_counts(items: Column | str) -> Column:
    """MAP<item, count> of an array."""
    c = F.coalesce(_c(items), F.array())
    return F.map_from_entries(F.transform(F.array_distinct(c), lambda x: F.struct(x, F.size(F.filter(c, lambda y: y == x)))))


def is_multiset_subset(required: Column | str, available: Column | str) -> Column:
    r, a = _c(required), _c(available)
    return F.forall(F.array_distinct(r), lambda x: F.size(F.filter(r, lambda y: y == x)) <= F.size(F.filter(a, lambda y: y == x)))


def wilson(wins: Column, decided: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Score interval of a rate; null bounds where nothing was decided."""
    n, p = decided.cast("double"), F.try_divide(wins.cast("double"), decided.cast("double"))
    middle = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    seen = decided > 0
    return F.when(seen, middle - half), F.when(seen, middle + half)
