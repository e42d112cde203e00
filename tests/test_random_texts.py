"""Any text at all is read without a crash and comes back as it was."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.functions import formats as M
from weftline.functions import glossary as G
from weftline.functions import includes as I
from weftline.functions import quality as Q
from weftline.functions import text as X
from weftline.sources import details as D
from weftline.sources import dialects as L
from weftline.sources import parsers as P

PIECES = ["# ", "## ", "- ", "* ", "1. ", "> ", "```", "~~~", "`", "``", "**", "*", "_", "[a](b)", "[a][b]", "![", "](", "|", "---", "===", "=====", "\n", "\n\n", "    ", "\t", "::", ".. note::", ".. list-table::", ":ref:`x`", "`x`_", "[1]_", "|===", "----", "<p>", "</p>", "<em>", "</em>", "<pre>", "<!--", "-->", "<x", '"', "'", "&amp;", "\\section{", "\\begin{align}", "\\end{align}", "\\item ", "\\item[a]", "$", "$$", "{", "}", "{note}", ":::", "!!! note", '=== "T"', "/- TEXT:\n", "TEXT. -/", "Title: x\n", "+---+---+\n", "| a | b |\n", "\0", "word", "Two words.", "한국어 문장입니다.", "é", "\U0001f600", "\r\n", "import X\n", "<Card a={1}>", "{r}", "@key", "~"]
TEXTS = st.lists(st.sampled_from(PIECES), max_size=40).map("".join)


@pytest.mark.parametrize("parser", sorted(P.PARSERS))
@settings(max_examples=120, deadline=None, derandomize=True)
@given(text=TEXTS)
def test_parsers(parser, text):
    found = P.segments(text, P.PARSERS[parser](text))
    assert P.reconstruct(text, found, {}, parser) == text
    assert all(0 <= s.start < s.end <= len(text) for s in found)


@settings(max_examples=300, deadline=None, derandomize=True)
@given(source=TEXTS, rendering=TEXTS)
def test_checks(source, rendering):
    for markup in ("markdown", "rst", "asciidoc", "latex", "verso", "rmarkdown", "xhtml", "bikeshed", "mkdocs"):
        assert Q.evaluate(source, source, markup) is not None and isinstance(Q.evaluate(source, rendering, markup), list)
        assert isinstance(Q.repair(markup, source, rendering), str)
        assert M.audit(markup, source, rendering, Q.construct_issues, Q.repair)[0] in ("Sound", "Repaired", "Unrepairable")
    text, tags = M.xml_tagify(source)
    assert not Q.tag_problems(text, tags) or "<g" in source or "<x" in source
    Q.untag(*Q.tagify(source))
    L.constructs(source, "rst"), L.constructs(source, "latex"), L.constructs(source, "xhtml"), L.constructs(source, "mdx")
    for read in L.TABLES.values():
        read(source)
    G.prose_chunks(source), G.verbatim_spans(source), X.split_sentences(source), X.extract_urls(source), X.off_register_endings(source)
    I.full_references(source, rendering, I.definition_labels(source)), I.include_targets(source), I.rewrite_lines(source, {})
    D.list_table(source), D.latex_cells(source), D.glossary_entries(source), M.without_reference_keys(source), M.verso_structure(source)


def test_long_texts_take_linear_time():
    """Twenty thousand repeats of each piece, which a scanner that starts again at every mark would not survive."""
    import time

    rng = random.Random(1)
    for piece in PIECES:
        text = (piece + rng.choice(["", "a", " "])) * 4000
        for name in ("markdown", "rst", "asciidoc", "latex", "cnxml", "mdx", "myst"):
            began = time.time()
            P.PARSERS[name](text)
            assert time.time() - began < 20, (name, piece)
