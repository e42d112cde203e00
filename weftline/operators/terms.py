"""Mining terms: n-gram counts, plural folding, coverage by longer n-grams, recurring whole segments, and glossary set operations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import glossary as G
from weftline.functions.columns import normalize_whole


def ngrams(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ngram, spelling) of every n-gram in a text's prose, by an Arrow-batched function; nulls have none."""
    kind = T.ArrayType(T.StructType([T.StructField("ngram", T.StringType()), T.StructField("spelling", T.StringType())]))

    @F.pandas_udf(kind)
    def grams(values: pd.Series) -> pd.Series:
        return pd.Series([[] if v is None else [g for c in G.prose_chunks(v) for g in G.ngrams(c)] for v in values], dtype=object)

    return texts.select(F.col(key), F.explode(grams(F.col(text))).alias("g")).select(key, "g.ngram", "g.spelling")


def counts(grams: DataFrame, least: int = 1) -> DataFrame:
    """(ngram, n), and capitals if grams have spellings: how many begin with a capital. Combined before the shuffle, so a frequent n-gram is no hot key."""
    capitals = [F.count_if(F.col("spelling").rlike(r"^\p{Lu}")).alias("capitals")] if "spelling" in grams.columns else []
    return grams.groupBy("ngram").agg(F.count("*").alias("n"), *capitals).filter(F.col("n") >= least)


def fold_plurals(counted: DataFrame) -> DataFrame:
    """(ngram, n) with the counts of plurals added to their singular, where that occurs; one simultaneous step. A plural nearly always capitalised whose singular nearly never is stays a word of its own (at least 0.9 against at most 0.1)."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def stems(values: pd.Series) -> pd.Series:
        return pd.Series([G.singulars(v) for v in values], dtype=object)

    share = F.col("capitals") / F.col("n") if "capitals" in counted.columns else F.lit(0.5)
    tried = counted.select("ngram", share.alias("plural_share"), F.posexplode(stems("ngram")).alias("k", "stem"))
    known = tried.join(counted.select(F.col("ngram").alias("stem"), share.alias("share")), "stem").groupBy("ngram", "plural_share").agg(F.min_by("stem", "k").alias("stem"), F.min_by("share", "k").alias("share"))
    kept = known.filter(~((F.col("plural_share") >= 0.9) & (F.col("share") <= 0.1))).select("ngram", "stem")
    return counted.join(kept, "ngram", "left").groupBy(F.coalesce("stem", "ngram").alias("ngram")).agg(F.sum("n").alias("n"))


def open_ngrams(counted: DataFrame, share: float = 0.9) -> DataFrame:
    """Without n-grams of which an n-gram one word longer holds at least `share` of the occurrences."""
    longer = counted.filter(F.col("ngram").contains(" ")).select(F.explode(F.array(F.regexp_replace("ngram", r"^\S+ ", ""), F.regexp_replace("ngram", r" \S+$", ""))).alias("ngram"), F.col("n").alias("m"))
    most = longer.groupBy("ngram").agg(F.max("m").alias("m"))
    return counted.join(most, "ngram", "left").filter(F.col("m").isNull() | (F.col("m") < F.lit(share) * F.col("n"))).select("ngram", "n")


def top(counted: DataFrame, limit: int) -> DataFrame:
    """The `limit` most frequent, ties by key."""
    return counted.orderBy(F.desc("n"), "ngram").limit(limit)


def usual_spelling(grams: DataFrame) -> DataFrame:
    """(ngram, spelling): the commonest spelling, of equally common ones the smallest."""
    each = grams.groupBy("ngram", "spelling").agg(F.count("*").alias("c"))
    return each.groupBy("ngram").agg(F.min(F.struct((-F.col("c")).alias("c"), "spelling")).alias("m")).select("ngram", "m.spelling")


def whole_variants(segments: DataFrame, source: str, translation: str, words: int = 6, chars: int = 80, least: int = 3) -> DataFrame:
    """(term, n, variants): short segments that open with a capital, recur at least `least` times and have two or more translations; those ranked by count and text. Untranslated rows count for n only; nulls and empty keys are left out."""
    text = F.regexp_replace(F.col(source), r"^\s+|\s+$", "")
    short = segments.filter(text.isNotNull() & (F.size(F.split(text, r"\s+")) <= words) & (F.length(text) <= chars) & F.regexp_replace(text, r"^[^\p{L}\p{N}]+", "").rlike(r"^\p{Lu}") & ~text.rlike(r",$"))
    each = short.groupBy(normalize_whole(source).alias("term"), normalize_whole(translation).alias("variant")).agg(F.count("*").alias("c")).filter("term <> ''")
    ranked = F.sort_array(F.collect_list(F.when(F.col("variant").isNotNull(), F.struct((-F.col("c")).alias("c"), "variant"))))
    found = each.groupBy("term").agg(F.sum("c").alias("n"), ranked.alias("v"))
    return found.filter((F.col("n") >= least) & (F.size("v") >= 2)).select("term", "n", F.transform("v", lambda x: x["variant"]).alias("variants"))


def merge_glossaries(curated: DataFrame, generated: DataFrame) -> DataFrame:
    """The curated entries and those generated ones whose term, in any case, is not curated; a null term is no entry."""
    key = F.lower("term")
    c, g = curated.filter("term is not null").withColumn("_k", key), generated.filter("term is not null").withColumn("_k", key)
    return c.unionByName(g.join(c.select("_k").distinct(), "_k", "left_anti"), allowMissingColumns=True).drop("_k")


def one_entry(entries: DataFrame) -> DataFrame:
    """Each term once, in lower case; of several entries the one whose row sorts first."""
    return entries.filter("term is not null").groupBy(F.lower("term").alias("term")).agg(F.min(F.struct("translation", "kind")).alias("m")).select("term", "m.translation", "m.kind")


def upsert(entries: DataFrame, changes: DataFrame, key: str = "term") -> DataFrame:
    """entries with the rows of changes in place of those of equal key; columns that changes lacks are kept from the entry."""
    kept = [c for c in entries.columns if c not in changes.columns]
    new = changes.join(entries.select(key, *kept), key, "left") if kept else changes
    return entries.join(changes.select(key), key, "left_anti").unionByName(new.select(*entries.columns))


def delete(entries: DataFrame, terms: DataFrame, key: str = "term") -> DataFrame:
    """entries without those whose key, in any case, is among terms."""
    gone = terms.select(F.lower(key).alias("_k")).distinct()
    return entries.join(gone, F.lower(F.col(key)) == F.col("_k"), "left_anti")


def decided(accepted: DataFrame, rejected: DataFrame, key: str = "term") -> DataFrame:
    """Keys, in lower case, of accepted and of rejected entries: what needs no decision any more."""
    return accepted.select(F.lower(key).alias(key)).unionByName(rejected.select(F.lower(key).alias(key))).filter(f"{key} is not null").distinct()


def used_terms(texts: DataFrame, terms: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term) for terms in a text by plain word boundaries; terms and words are joined by their first word, so no text meets every term."""
    t = terms.filter("term is not null and trim(term) <> ''").select(F.lower("term").alias("term")).distinct().withColumn("w", F.element_at(F.split("term", r"[^\p{L}\p{N}]+"), 1))
    words = texts.filter(F.col(text).isNotNull()).select(F.col(key), F.lower(F.col(text)).alias("low")).withColumn("w", F.explode(F.array_distinct(F.regexp_extract_all("low", F.lit(r"([\p{L}\p{N}]+)"), 1))))
    inside = F.concat(F.lit(" "), F.regexp_replace("low", r"[^\p{L}\p{N}]+", " "), F.lit(" ")).contains(F.concat(F.lit(" "), F.regexp_replace("term", r"[^\p{L}\p{N}]+", " "), F.lit(" ")))
    return words.join(t, "w").filter(inside).select(key, "term").distinct()
