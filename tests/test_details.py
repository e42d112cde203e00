import pytest

from weftline.sources import details as D


def test_asciidoc_tables():
    assert D.cell_spec("2+") == D.CellSpec(2, 1, 1) and D.cell_spec(".3+a") == D.CellSpec(1, 3, 1, "a") and D.cell_spec("3*") == D.CellSpec(1, 1, 3)
    assert D.cell_spec("text") is None
    assert D.declared_columns('[cols="1,2*,3"]') == 4 and D.declared_columns("[%header]") is None
    assert D.block_style("[source,ruby]") == "source" and D.block_style("[#id]") is None
    cells = [(D.CellSpec(2), "a"), (D.CellSpec(1, 2), "b"), (D.CellSpec(), "c"), (D.CellSpec(), "d"), (D.CellSpec(repeat=3), "e")]
    assert D.flow_cells(cells, 3) == [["a", None, "b"], ["c", "d", None], ["e", "e", "e"]]


def test_rst():
    assert [D.roman(x) for x in ("iv", "MCMXCIV", "iiii", "")] == [4, 1994, None, None]
    assert D.enumerator("12. x") == ("arabic", 12, 3) and D.enumerator("(b) x") == ("alpha", 2, 3) and D.enumerator("ii) x") == ("roman", 2, 3)
    assert D.enumerator("#. x") == ("auto", 0, 2) and D.enumerator("word. x") is None and D.enumerator("(a. x") is None
    assert D.list_table("* - a\n  - b\n* - c\n    more\n  - d") == [["a", "b"], ["c more", "d"]]
    assert D.csv_table('a, "b, c"\n\nd, e') == [["a", "b, c"], ["d", "e"]]
    assert D.malformed_roles(":ref:`a`를 and :ref:`b` and :ref:`c") == [":ref:`a`", ":ref:`c"]


def test_latex():
    assert D.latex_cells("a & \\textbf{b & c} & d\\& e \\\\") == ["a", "\\textbf{b & c}", "d\\& e"]
    assert D.visible_arguments("x \\emph{y} \\label{z}") == [("y", 8)]
    assert D.environment_stack("\\begin{a}\\begin{b}\\end{b}\\begin{c}") == ("a", "c")


def test_xml():
    assert D.skeleton('<a y="1" x="2">text<b/></a>') == D.skeleton('<a x="2" y="1"><b></b>other</a>')
    assert D.well_formed("<a/>") and not D.well_formed("<a>") and not D.well_formed("")


def test_dialects():
    text = 'x <Card title="a > b" on={{k: 1}} /> y'
    end, name, attributes = D.jsx_tag(text, 2)
    assert text[2:end].endswith("/>") and name == "Card" and attributes["title"] == "a > b"
    assert D.jsx_tag("a < b", 2) is None
    assert D.glossary_entries("one\nuno\n  First.\n  More.\n\ntwo\n  Second.") == [(["one", "uno"], "First. More."), (["two"], "Second.")]
    assert D.restore_shorthand(D.shorthand_links("See [[REF]] and [[#part]].")) == "See [[REF]] and [[#part]]."


def test_spans():
    D.validate_spans("a가b".encode(), [(0, 1), (1, 4)])
    for bad in ([(0, 2)], [(1, 4), (0, 1)], [(0, 99)]):
        with pytest.raises(ValueError):
            D.validate_spans("a가b".encode(), bad)
