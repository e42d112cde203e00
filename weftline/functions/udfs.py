"""Vectorised versions of the Python text functions, for columns."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import glossary as G
from weftline.functions import text as X

HASH = T.DecimalType(20, 0)
STRINGS = T.ArrayType(T.StringType())


def _mapped(fn: Callable, kind: T.DataType):
    """A pandas UDF that applies fn to each value; null stays null."""

    @F.pandas_udf(kind)
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else fn(v) for v in values], dtype=object)

    return run


content_hash = _mapped(lambda t: Decimal(X.content_hash(t)), HASH)
sentences = _mapped(X.split_sentences, STRINGS)
off_register = _mapped(X.off_register_endings, STRINGS)


@F.pandas_udf(HASH)
def context_hash(before: pd.Series, after: pd.Series) -> pd.Series:
    none = lambda v: 0 if v is None or v != v else int(v)
    return pd.Series([Decimal(X.context_hash(none(a), none(b))) for a, b in zip(before, after)], dtype=object)


def seeded_key(seed: object, *columns) -> Column:
    """A reproducible random order: the unsigned XXH64 of seed and columns, joined by colons."""
    named = [F.col(c) if isinstance(c, str) else c for c in columns]
    return content_hash(F.concat_ws(":", F.lit(str(seed)), *(c.cast("string") for c in named)))


def glossary_terms(glossary: G.Glossary):
    """MAP<term, translation> of the terms a text uses. The glossary travels with the function: its size is checked when it is built."""

    @F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else glossary.find(v) for v in values], dtype=object)

    return run


@F.pandas_udf(STRINGS)
def quality_issues(source: pd.Series, rendering: pd.Series, markup: pd.Series) -> pd.Series:
    from weftline.functions import quality

    return pd.Series([None if s is None or r is None else quality.evaluate(s, r, m or "markdown") for s, r, m in zip(source, rendering, markup)], dtype=object)


@F.pandas_udf(T.StringType())
def repaired(source: pd.Series, rendering: pd.Series, markup: pd.Series) -> pd.Series:
    """The rendering after the repairs of its markup; as it is without a source."""
    from weftline.functions import quality

    return pd.Series([r if s is None or r is None else quality.repair(m or "markdown", s, r) for s, r, m in zip(source, rendering, markup)], dtype=object)


@F.pandas_udf(T.StructType().add("outcome", T.StringType()).add("text", T.StringType()).add("defects", STRINGS))
def audited(source: pd.Series, rendering: pd.Series, markup: pd.Series) -> pd.DataFrame:
    """Sound, Repaired or Unrepairable, with the text after repair and the defects; null where a side is null."""
    from weftline.functions import formats, quality

    rows = [(None, None, None) if s is None or r is None else formats.audit(m or "markdown", s, r, quality.construct_issues, quality.repair) for s, r, m in zip(source, rendering, markup)]
    return pd.DataFrame(rows, columns=["outcome", "text", "defects"])


@F.pandas_udf(T.StructType().add("tagged", T.StringType()).add("same", T.BooleanType()).add("prose", T.StringType()))
def xml_tags(source: pd.Series) -> pd.DataFrame:
    """An XML fragment with its elements as numbered tags, whether it comes back, and its visible text."""
    from weftline.functions import formats, quality

    rows = []
    for s in source:
        if s is None:
            rows.append((None, None, None))
        else:
            text, tags = formats.xml_tagify(s)
            rows.append((text, quality.untag(text, tags) == s, formats.xml_prose(s)))
    return pd.DataFrame(rows, columns=["tagged", "same", "prose"])


@F.pandas_udf(T.StringType())
def tagged(source: pd.Series) -> pd.Series:
    from weftline.functions import quality

    return pd.Series([None if s is None else quality.tagify(s)[0] for s in source], dtype=object)


@F.pandas_udf(T.BooleanType())
def tags_come_back(source: pd.Series) -> pd.Series:
    """Whether a text with its markup as tags, turned back, is itself."""
    from weftline.functions import quality

    return pd.Series([None if s is None else quality.untag(*quality.tagify(s)) == s for s in source], dtype=object)


@F.pandas_udf(T.MapType(T.StringType(), T.IntegerType()))
def token_counts(values: pd.Series) -> pd.Series:
    """How often a text holds each kind of reference, definition, formula and token; kinds that it lacks are left out."""
    kinds = {
        "destination": X.markdown_destinations, "code label": X.code_reference_labels, "definition": X.definition_labels, "named reference": X.rst_named_references, "embedded link": X.rst_embedded_links,
        "defined name": X.rst_defined_names, "bikeshed token": X.bikeshed_tokens, "formula": X.math_spans, "preserved token": X.preserved_tokens, "address": X.extract_urls,
    }
    found = []
    for v in values:
        counts = None if v is None else {k: len(f(v)) for k, f in kinds.items()} | {"anonymous reference": X.rst_anonymous_references(v)}
        found.append(counts and {k: n for k, n in counts.items() if n})
    return pd.Series(found, dtype=object)
