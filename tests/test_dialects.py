from weftline.sources import dialects as X
from weftline.sources import parsers as P


def texts(parser, text):
    return [(s.kind, s.source) for s in P.segments(text, P.PARSERS[parser](text))]


def test_cnxml():
    doc = '<document><title>Energy</title><content><section><title>Work &amp; heat</title><para id="a">First <term>word</term>. Second.</para><list><item>One</item></list><equation><math>x</math></equation><figure><media alt="A chart"/></figure><preformat>code here</preformat></section></content></document>'
    got = texts("cnxml", doc)
    assert ("heading", "Energy") in got and ("paragraph", "First <term>word</term>.") in got and ("item", "One") in got and ("attribute", "A chart") in got
    assert not any("code here" in t or "<math>" in t for _, t in got)
    levels = {doc[b.start : b.end]: b.level for b in P.PARSERS["cnxml"](doc) if b.kind == "heading"}
    assert levels == {"Energy": 1, "Work &amp; heat": 2}
    found = P.segments(doc, P.PARSERS["cnxml"](doc))
    attribute = next(s for s in found if s.kind == "attribute")
    assert 'alt="A &quot;b&quot; &amp; &lt;c&gt;"'.replace("&gt;", ">") in P.reconstruct(doc, found, {attribute.id: 'A "b" & <c>'}, "cnxml")


def test_pretext():
    doc = "<book><chapter><title>Sets</title><p>Let <m>x</m> be in <em>a</em> set.</p><theorem><statement><p>It holds.</p></statement></theorem><sage><input>no()</input></sage><p translate=\"no\">kept as is</p></chapter></book>"
    got = [t for _, t in texts("pretext", doc)]
    assert got == ["Sets", "Let <m>x</m> be in <em>a</em> set.", "It holds."]


def test_strict_xhtml():
    got = texts("xhtml_strict", '<h2>T</h2><p>One <code>a</code> two.</p><pre>no</pre><ul><li>x y<br/>z</li></ul><img alt="An image"/>')
    assert ("heading", "T") in got and ("paragraph", "One <code>a</code> two.") in got and ("attribute", "An image") in got and not any("no" == t for _, t in got)
    assert X.xml_blocks("", X.VOCABULARIES["xhtml"]) == [] and X.xml_blocks("<p>open", X.VOCABULARIES["xhtml"]) == [("paragraph", 3, 7, 0)]


PEP = "PEP: 1\nTitle: The purpose\nAuthor: Someone <a@b.example>\nStatus: Active\n\nAbstract\n========\n\nText of it.\n"


def test_proposals():
    got = [t for _, t in texts("pep", PEP)]
    assert got == ["The purpose", "Abstract", "Text of it."]
    plain = "PEP: 9\nTitle: Sample\n\n::\n\n    Prose of the template.\n"
    assert [t for _, t in texts("pep_plaintext", plain)] == ["Sample", "Prose of the template."]
    zen = PEP + "\n.. code-block:: text\n\n    Beautiful is better.\n    Simple is better.\n\nEnd of it.\n"
    assert [t for _, t in texts("pep_text", zen)] == ["The purpose", "Abstract", "Text of it.", "Beautiful is better.", "Simple is better.", "End of it."]
    assert P.reconstruct(zen, P.segments(zen, P.PARSERS["pep_text"](zen)), {}, "pep") == zen


def test_prose_in_lean():
    text = "import Mathlib\n/- TEXT:\nSets\n----\n\nA set is here.\nTEXT. -/\nexample : True := trivial\n/- TEXT:\nMore prose.\nEXAMPLES: -/\n"
    assert [t for _, t in texts("mathematics_in_lean", text)] == ["Sets", "A set is here.", "More prose."]


def test_further_latex():
    text = "\\begin{theorem}[Main result]\nIt is so.\n\\end{theorem}\n\\begin{align}a &= b && \\text{by the lemma}\\\\ c &= \\text{d}\\end{align}\n\\item[First label] body\n"
    plain, more = [t for _, t in texts("latex", text)], [t for _, t in texts("latex_extended", text)]
    assert "by the lemma" in more and "by the lemma" not in plain and any("Main result" in t for t in more)
    assert X.has_prose("\\emph{word}") and not X.has_prose("\\label{word} $x$ \\cite{key}")
    assert X.cell_has_prose("some words") and not X.cell_has_prose("``code``") and not X.cell_has_prose(":ref:`x`")


def test_tables_of_each_markup():
    grid = "+-----+-----+\n| a   | b c |\n|     | d   |\n+=====+=====+\n| e         |\n+-----+-----+\n"
    assert X.rst_tables(grid) == [[["a", "b c d"], ["e", ""]]]
    simple = "===  ======\na    b\n===  ======\nc    d e\n     f\n===  ======\n"
    assert X.rst_tables(simple) == [[["a", "b"], ["c", "d e f"]]]
    lists = ".. list-table:: T\n   :header-rows: 1\n\n   * - a\n     - b\n   * - c\n     - d\n\n.. csv-table::\n\n   x, \"y, z\"\n   1, 2\n"
    assert X.rst_tables(lists) == [[["a", "b"], ["c", "d"]], [["x", "y, z"], ["1", "2"]]]
    adoc = '[cols="1,2"]\n|===\n|a |b\n2+|wide\n|c |d\n|===\n'
    assert X.asciidoc_tables(adoc) == [[["a", "b"], ["wide", ""], ["c", "d"]]]
    assert X.latex_tables("\\begin{tabular}{ll}\\hline\na & b \\\\\n\\hline c & d \\\\\n\\end{tabular}") == [[["a", "b"], ["c", "d"]]]
    assert X.markdown_tables("| a | b |\n|---|---|\n| c | d |\n") == [[["a", "b"], ["c", "d"]]]
    assert all(read("") == [] for read in X.TABLES.values())


def test_underlines_follow_titles():
    text = "=====\nTitle\n=====\n\nPart\n----\n\nText.\n"
    found = P.segments(text, P.rst(text))
    out = P.reconstruct(text, found, {found[0].id: "아주 긴 제목", found[1].id: "부분의 이름"}, "rst")
    lines = out.split("\n")
    assert lines[1] == "아주 긴 제목" and len(lines[0]) == len(lines[2]) >= 12 and lines[5] == "-" * 11
    assert [s.source for s in P.segments(out, P.rst(out))] == ["아주 긴 제목", "부분의 이름", "Text."]


def test_constructs_are_counted():
    assert X.constructs("1. a\n2. b\n:ref:`x`y", "rst") == {"enumerator": 2, "malformed role": 1}
    assert X.constructs("\\begin{a} \\emph{b}", "latex") == {"visible argument": 1, "open environment": 1}
    assert X.constructs("<p>a</p>", "xhtml")["well formed"] == 1 and "well formed" not in X.constructs("<p>a", "xhtml")
    assert X.constructs("```{glossary}\na\n  b\n```\n<Card x={1} /> [[REF]]", "myst") == {"jsx tag": 1, "shorthand": 1, "glossary entry": 1}


def test_indented_code():
    assert texts("markdown", "Text.\n\n    code here\n\n    more code\n\nEnd.\n") == [("paragraph", "Text."), ("paragraph", "End.")]
    # what belongs to a list item is prose
    assert ("paragraph", "Second paragraph.") in texts("markdown", "- item\n\n    Second paragraph.\n")
    assert texts("markdown", "Long\n    continued.\n") == [("paragraph", "Long continued.")]


def test_admonitions_and_tabs():
    text = '!!! note "A title"\n    Inside it.\n\n    Still inside.\n\n=== "Tab one"\n\n    In the tab.\n\n???+ tip\n    Open.\n\nOutside.\n\n    code\n'
    got = [t for _, t in texts("mkdocs", text)]
    assert got == ["A title", "Inside it.", "Still inside.", "Tab one", "In the tab.", "Open.", "Outside."]
    assert P.reconstruct(text, P.segments(text, P.PARSERS["mkdocs"](text)), {}) == text


def test_prose_directives():
    text = "(target)=\n```{note} Mind this\n:class: x\nProse of the note.\n```\n\n```{code-block} python\nx = 1\n```\n\n:::{tip}\nA tip.\n:::\n"
    assert [t for _, t in texts("myst", text)] == ["Prose of the note.", "A tip."]


def test_components():
    text = 'import X from "x"\n\n<Card\n  title="a > b"\n  on={{k: 1}}\n>\n\nInside the card.\n\n</Card>\n\n{value}\n\nUse <B>it</B> inline.\n'
    assert [t for _, t in texts("mdx", text)] == ["Inside the card.", "Use <B>it</B> inline."]


def test_cells_of_several_lines_are_drawn_anew():
    text = "Before.\n\n  +-------+---------+\n  | Name  | What it |\n  |       | does    |\n  +=======+=========+\n  | ``x`` | Reads a |\n  |       | line.   |\n  +-------+---------+\n\nAfter.\n"
    found = P.segments(text, P.rst(text))
    assert [(s.kind, s.source) for s in found] == [("paragraph", "Before."), ("cell", "Name"), ("cell", "What it does"), ("cell", "Reads a line."), ("paragraph", "After.")]
    assert P.reconstruct(text, found, {}, "rst") == text
    out = P.reconstruct(text, found, {found[3].id: "줄을 읽습니다."}, "rst")
    assert out.startswith("Before.\n\n  +-------+") and "| ``x`` | 줄을 읽습니다. |" in out and out.count("=") > 4 and out.endswith("\n\nAfter.\n")
    again = P.segments(out, P.rst(out))
    assert [s.source for s in again] == ["Before.", "Name", "What it does", "줄을 읽습니다.", "After."]
    # a cell that spans columns is left to the plain reading
    assert not X.is_plain_grid(["+--+--+", "| a   |", "+--+--+"]) and not X.is_plain_grid([])


def test_manifests():
    import pytest

    text = "#doc\n가나 첫 문장.\nEnd."
    raw = text.encode()
    spans = [(raw.index("가".encode()), raw.index(b"\nEnd"), "paragraph"), (raw.index(b"End"), len(raw), "paragraph")]
    found = P.segments(text, P.manifest(text, spans))
    assert [s.source for s in found] == ["가나 첫 문장.", "End."]
    assert P.reconstruct(text, found, {found[1].id: "끝."}) == "#doc\n가나 첫 문장.\n끝."
    with pytest.raises(ValueError):
        P.manifest(text, [(spans[0][0] + 1, spans[0][1], "paragraph")])
    assert P.manifest("", []) == []
