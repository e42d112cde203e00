"""Dialects on top of the document parsers: XML vocabularies, enhancement proposals, prose inside Lean sources, further LaTeX text; tables read as grids."""

from __future__ import annotations

import re
from dataclasses import dataclass

from weftline.functions.text import display_width
from weftline.sources import details as D

# --- XML vocabularies


@dataclass(frozen=True)
class Vocabulary:
    """What the elements of an XML vocabulary are. Without `blocks` every element is a block that is neither inline nor skipped."""

    skipped: frozenset[str]
    code: frozenset[str]
    attributes: frozenset[str]
    blocks: frozenset[str] = frozenset()
    inline: frozenset[str] = frozenset()
    sections: frozenset[str] = frozenset()
    titles: frozenset[str] = frozenset()

    def is_block(self, name: str) -> bool:
        return name in self.blocks if self.blocks else name not in self.inline and name not in self.code and name not in self.skipped


# The elements of the vocabularies.
VOCABULARIES = {
    "xhtml": Vocabulary(
        frozenset("pre script style math svg object iframe template textarea select".split()),
        frozenset("code kbd samp tt".split()),
        frozenset("alt title".split()),
        blocks=frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol p pre section summary table tbody td tfoot th thead tr ul".split()),
    ),
    "cnxml": Vocabulary(
        frozenset("math preformat iframe object embed".split()),
        frozenset("code".split()),
        frozenset("alt summary".split()),
        blocks=frozenset("caption collection commentary content definition document entry equation example exercise figure footnote glossary item label list meaning metadata note para preformat problem proof quote row rule section seealso solution statement subcollection subfigure table tbody tfoot tgroup thead title".split()),
        sections=frozenset("document section collection subcollection".split()),
        titles=frozenset(["title"]),
    ),
    "pretext": Vocabulary(
        frozenset("asymptote cd console docinfo idx image input interactive latex-code latex-image-code macros mathbox md mdn me men output pre program sage sageplot usage video".split()),
        frozenset("m c".split()),
        frozenset(["type-name"]),
        inline=frozenset(
            "abbr acro alert articletitle attr booktitle c delete dq em email fillin fn foreign icon init insert kbd m personname pubtitle q quantity sq stale sub sup tag tage taxon term url var xref ad am ampersand asterisk backslash bc circa circumflex copyleft copyright degree dollar eg ellipsis etc gt greater hash ie latex lbrace ldq less lsq lt mdash midpoint minus nb nbsp ndash obelus percent permille phonomark pilcrow plusminus pm pretext prime ps rbrace rdq registered rsq section-mark servicemark slash solidus swungdash tex tilde times today trademark underscore viz vs xelatex xetex restrict-version".split()
        ),
        sections=frozenset("acknowledgement appendix article backmatter biography book chapter colophon exercises foreword frontmatter glossary index paragraphs part preface reading-questions references section solutions subsection subsubsection worksheet".split()),
        titles=frozenset("title subtitle shorttitle".split()),
    ),
}
_ITEMS, _CELLS = frozenset("li item dd dt".split()), frozenset("td th entry cell".split())
_MARKUP = re.compile(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<![^>]*>|<(?P<close>/)?(?P<name>[A-Za-z][\w:.-]*)(?P<rest>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*?)(?P<self>/)?>", re.DOTALL)
_ATTRIBUTE = re.compile(r"([\w:.-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


def xml_blocks(text: str, vocabulary: Vocabulary) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, level) of the runs of prose directly inside block elements, and of the attributes that readers see.

    A title's level is the number of sections around it. Elements marked translate="no" are skipped with all they hold; a text that is not well formed is read as far as it goes.
    """
    found: list[tuple[str, int, int, int]] = []
    stack: list[str] = []
    hidden, run = 0, None

    def kind() -> tuple[str, int]:
        block = next((n for n in reversed(stack) if vocabulary.is_block(n)), "p")
        depth = sum(n in vocabulary.sections for n in stack)
        if block in vocabulary.titles:
            return "heading", max(1, depth)
        if re.fullmatch(r"h[1-6]", block):
            return "heading", int(block[1])
        return ("item" if block in _ITEMS else "cell" if block in _CELLS else "quote" if block in ("blockquote", "quote") else "paragraph"), 0

    def close(end: int) -> None:
        nonlocal run
        if run is not None:
            body = text[run:end]
            if any(c.isalnum() for c in re.sub(r"<[^>]*>|&[#\w]+;", "", body)):
                a = run + len(body) - len(body.lstrip())
                what, level = kind()
                found.append((what, a, run + len(body.rstrip()), level))
        run = None

    at = 0
    for m in _MARKUP.finditer(text):
        if run is None and not hidden and text[at : m.start()].strip():
            run = at
        at = m.end()
        if not m["name"]:
            if not m[0].startswith("<![CDATA["):
                close(m.start())
            continue
        name = m["name"].split(":")[-1]
        alone = bool(m["self"]) or (name in _VOID and bool(vocabulary.blocks))
        if not m["close"]:
            attributes = {a[1]: a for a in _ATTRIBUTE.finditer(m["rest"])}
            no = "translate" in attributes and (attributes["translate"][2] or attributes["translate"][3]) == "no"
            if not hidden and not no:
                for a in attributes.values():
                    g = 2 if a[2] is not None else 3
                    if a[1] in vocabulary.attributes and any(c.isalpha() for c in a[g]):
                        found.append(("attribute", m.start("rest") + a.start(g), m.start("rest") + a.end(g), 0))
            if hidden or no or name in vocabulary.skipped:
                if not alone:
                    if not hidden and vocabulary.is_block(name):
                        close(m.start())
                    hidden += 1
                continue
            if vocabulary.is_block(name):
                close(m.start())
            elif run is None:
                run = m.start()
            if not alone:
                stack.append(name)
        elif hidden:
            hidden -= 1
        else:
            if vocabulary.is_block(name):
                close(m.start())
            if name in stack:
                while stack.pop() != name:
                    pass
    if run is None and not hidden and text[at:].strip():
        run = at
    close(len(text))
    return sorted(found, key=lambda b: (b[1], b[2]))


def escape_attribute(value: str) -> str:
    """A translation as the value of an attribute, in either quotes."""
    return re.sub(r"&(?!#?\w+;)", "&amp;", value).replace("<", "&lt;").replace('"', "&quot;").replace("'", "&apos;")


# --- what is hidden from the scan, as ranges

#: Marks that end a prose region of the Lean book.
_REGION = re.compile(r"/- TEXT:[^\n]*\n(?P<body>.*?)(?=^(?:TEXT\. -/|EXAMPLES: -/|SOLUTIONS: -/|BOTH: -/|OMIT: -/)|\Z)", re.DOTALL | re.MULTILINE)


def _outside(text: str, kept: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out, at = [], 0
    for a, b in kept:
        out.append((at, a))
        at = b
    return [*out, (at, len(text))]


def pep_hidden(text: str) -> list[tuple[int, int]]:
    """The preamble up to the first blank line, but for the value of Title."""
    end = re.search(r"\n[ \t]*\n", text)
    stop = end.start() if end else len(text)
    if not re.match(r"[\w-]+:", text):
        return []
    title = re.compile(r"^Title:[ \t]*(\S[^\n]*(?:\n[ \t]+\S[^\n]*)*)", re.MULTILINE).search(text, 0, stop)
    return [(0, title.start(1)), (title.end(1), stop)] if title else [(0, stop)]


def pep_plain_hidden(text: str) -> list[tuple[int, int]]:
    """The preamble, and the mark that makes the whole body one literal block."""
    mark = re.compile(r"^[ \t]*::[ \t]*$", re.MULTILINE).search(text)
    return pep_hidden(text) + ([mark.span()] if mark else [])


_TEXT_BLOCK = re.compile(r"^(?P<i>[ \t]*)\.\. code-block:: text[ \t]*\n(?P<body>(?:[ \t]*\n|(?P=i)[ \t]+[^\n]*(?:\n|\Z))+)", re.MULTILINE)


def pep_text_lines(text: str) -> list[tuple[int, int]]:
    """The lines of text blocks, each a passage of its own."""
    found = []
    for m in _TEXT_BLOCK.finditer(text):
        found += [(m.start("body") + x.start(1), m.start("body") + x.end(1)) for x in re.finditer(r"^[ \t]*(\S[^\n]*?)[ \t]*$", m["body"], re.MULTILINE)]
    return found


def lean_hidden(text: str) -> list[tuple[int, int]]:
    """All but the prose regions of a Lean source."""
    return _outside(text, [m.span("body") for m in _REGION.finditer(text)])


# --- further text of LaTeX

_LABELLED = re.compile(r"\\begin\{(?:theorem|lemma|proposition|corollary|definition|example|remark|proof|exercise|problem|claim|conjecture|note)\*?\}\[([^\[\]]+)\]|\\item\[([^\[\]]+)\]|\\(?:parbox(?:\[[^\]]*\])*\{[^{}]*\}|intertext|shortintertext|Comment)\{([^{}]+)\}")
_REASON = re.compile(r"\\(?:text|tag\*?|mbox|textrm)\{([^{}]*\s[^{}]*)\}")
_DISPLAYED = re.compile(r"\\begin\{(equation|align|gather|multline)(\*?)\}.*?\\end\{\1\2\}|\\\[.*?\\\]", re.DOTALL)


def latex_extra(text: str) -> list[tuple[int, int]]:
    """Titles of theorems, labels of descriptions, texts of boxes and comments, and reasons written inside displayed formulas."""
    found = [next(m.span(k) for k in (1, 2, 3) if m[k] is not None) for m in _LABELLED.finditer(text)]
    for d in _DISPLAYED.finditer(text):
        found += [(d.start() + m.start(1), d.start() + m.end(1)) for m in _REASON.finditer(d[0])]
    return sorted((a, b) for a, b in found if has_prose(text[a:b]))


def has_prose(text: str) -> bool:
    """Whether a letter is left of a text without its commands, formulas and keys: what a reader sees as words."""
    bare = re.sub(r"\$[^$]*\$|\\\(.*?\\\)|\\(?:label|ref|eqref|cite\w*|input|include\w*|url)\*?(?:\[[^\]]*\])*\{[^{}]*\}|\\[A-Za-z]+\*?", " ", text)
    return re.search(r"[^\W\d_]", bare) is not None


def cell_has_prose(cell: str) -> bool:
    """Whether a table cell holds words apart from literals, roles' targets and marks."""
    bare = re.sub(r"``[^`]*``|:[\w.+-]+:`[^`]*`|`[^`<]*<[^>]*>`_{1,2}|\|[^|]*\||https?://\S+", " ", cell)
    return re.search(r"[^\W\d_]{2}", bare) is not None


# --- tables as grids


def rst_grid(lines: list[str]) -> list[list[str]]:
    """Cells of a grid table by the columns of its border; a cell that spans columns fills the first of them."""
    edges = [m.start() for m in re.finditer(r"\+", lines[0])]
    rows: list[list[list[str]]] = []
    fresh = True
    for line in lines:
        if re.match(r"^\+[-=+]+\+\s*$", line):
            fresh = True
            continue
        if fresh:
            rows.append([[] for _ in edges[1:]])
            fresh = False
        at = 0
        for k in range(1, len(edges)):
            if k == len(edges) - 1 or (edges[k] < len(line) and line[edges[k]] in "|+"):
                rows[-1][at].append(line[edges[at] + 1 : edges[k]].strip())
                at = k
    return [[" ".join(x for x in cell if x) for cell in row] for row in rows]


def is_plain_grid(lines: list[str]) -> bool:
    """Whether a grid table has no cell that spans: every line has a mark at each edge of the first border."""
    if not lines or not re.match(r"^\+[-=+]+\+$", lines[0]) or not re.match(r"^\+[-=+]+\+$", lines[-1]):
        return False
    edges = [m.start() for m in re.finditer(r"\+", lines[0])]
    return all(len(line) == len(lines[0]) and all(line[e] in ("+" if line.startswith("+") else "|") for e in edges) for line in lines)


def redrawn(table: str, indent: str, texts: dict[int, str]) -> str:
    """A grid table with new texts in some of its cells, counted row by row, drawn at display widths; the header's rule stays where it was."""
    from weftline.functions.quality import grid_table

    lines = [line.strip() for line in table.split("\n")]
    grid = rst_grid(lines)
    columns = len(grid[0])
    rows = [[texts.get(r * columns + c, cell) for c, cell in enumerate(row)] for r, row in enumerate(grid)]
    drawn = grid_table(rows, header=False).split("\n")
    borders = [line for line in lines if line.startswith("+")]
    for k, border in enumerate(borders):
        if "=" in border:
            drawn[2 * k] = drawn[2 * k].replace("-", "=")
    return ("\n" + indent).join(drawn)


def _rst_simple(lines: list[str]) -> list[list[str]]:
    """Cells of a simple table by the columns of its rule; a row with an empty first cell goes on with the one before."""
    spans = [m.span() for m in re.finditer("=+", lines[0])]
    rows: list[list[str]] = []
    for line in lines:
        if re.match(r"^[=\- ]+$", line):
            continue
        cells = [line[a : spans[k + 1][0] if k + 1 < len(spans) else len(line)].strip() for k, (a, _) in enumerate(spans)]
        if rows and not cells[0]:
            rows[-1] = [" ".join(x for x in pair if x) for pair in zip(rows[-1], cells)]
        else:
            rows.append(cells)
    return rows


def rst_tables(text: str) -> list[list[list[str]]]:
    """Grid and simple tables, list-table and csv-table directives, in the order of the text."""
    found: list[tuple[int, list[list[str]]]] = []
    for m in re.finditer(r"^[ \t]*\+[-=+]+\+[ \t]*\n(?:[ \t]*[+|][^\n]*(?:\n|\Z))+", text, re.MULTILINE):
        found.append((m.start(), rst_grid([line.strip() for line in m[0].strip("\n").split("\n")])))
    for m in re.finditer(r"^=+(?:[ ]+=+)+[ ]*\n(?:(?!\n)[^\n]*\n)*?=+(?:[ ]+=+)+[ ]*\n(?:(?:(?!\n)[^\n]+\n)+?=+(?:[ ]+=+)+[ ]*$)?", text + "\n", re.MULTILINE):
        found.append((m.start(), _rst_simple(m[0].strip("\n").split("\n"))))
    for m in re.finditer(r"^(?P<i>[ \t]*)\.\. (?P<k>list-table|csv-table)::[^\n]*\n(?P<b>(?:[ \t]*\n|(?P=i)[ \t]+[^\n]*(?:\n|\Z))*)", text, re.MULTILINE):
        body = "\n".join(line.strip() if m["k"] == "csv-table" else line for line in m["b"].split("\n") if not re.match(r"^\s*:[\w-]+:", line))
        found.append((m.start(), D.list_table(body) if m["k"] == "list-table" else D.csv_table(body)))
    return [t for _, t in sorted(found, key=lambda x: x[0]) if t]


def asciidoc_tables(text: str) -> list[list[list[str]]]:
    """Tables as grids: specifiers before a bar repeat and span cells; without declared columns the first line tells their number."""
    found = []
    for m in re.finditer(r"^(?:(?P<a>\[[^\n]*\])\n)?(?:\.[^\n]*\n)?\|={3,}[ \t]*\n(?P<b>.*?)^\|={3,}[ \t]*$", text, re.MULTILINE | re.DOTALL):
        cells, first = [], 0
        for line in m["b"].split("\n"):
            for c in re.finditer(r"(?:(?<=\s)|^)(?P<s>(?:\d+)?(?:\.\d+)?[+*]?[<^>]?(?:\.[<^>])?[adehlmsv]?)\|(?P<t>(?:[^|\s]|\s(?!(?:\d+)?(?:\.\d+)?[+*]?[<^>]?[adehlmsv]?\|))*)", line):
                cells.append((D.cell_spec(c["s"]) or D.CellSpec(), c["t"].strip()))
            if cells and not first:
                first = sum(s.columns * s.repeat for s, _ in cells)
        columns = D.declared_columns(m["a"] or "") or first
        if columns:
            found.append([["" if v is None else v for v in row] for row in D.flow_cells(cells, columns)])
    return found


def latex_tables(text: str) -> list[list[list[str]]]:
    """Rows of tabular environments."""
    found = []
    for m in re.finditer(r"\\begin\{(tabular[xy*]?|longtable)\}(?:\[[^\]]*\])?(?:\{[^{}]*\}){1,2}(?P<b>.*?)\\end\{\1\}", text, re.DOTALL):
        rows = [r for r in re.split(r"(?<=\\\\)(?:\[[^\]]*\])?\s*", m["b"]) if re.sub(r"\\(?:hline|toprule|midrule|bottomrule|cline\{[^}]*\})", "", r).strip()]
        found.append([[re.sub(r"\\(?:hline|toprule|midrule|bottomrule|cline\{[^}]*\})\s*", "", c).strip() for c in D.latex_cells(r)] for r in rows])
    return found


def markdown_tables(text: str) -> list[list[list[str]]]:
    found = []
    for m in re.finditer(r"^[ \t]*\|[^\n]*\n[ \t]*\|?[ \t]*:?-+:?[ \t|:\-]*\n(?:[ \t]*\|[^\n]*(?:\n|\Z))*", text, re.MULTILINE):
        rows = [line.strip().strip("|").split("|") for k, line in enumerate(m[0].strip("\n").split("\n")) if k != 1]
        found.append([[c.strip() for c in r] for r in rows])
    return found


TABLES = {"rst": rst_tables, "asciidoc": asciidoc_tables, "latex": latex_tables, "markdown": markdown_tables}


# --- constructs that a document holds


def constructs(text: str, parser: str) -> dict[str, int]:
    """How often a document holds constructs that its parser reads apart."""
    found: dict[str, int] = {}
    if parser == "rst":
        lines = [line.strip() for line in text.split("\n")]
        found["enumerator"] = sum(D.enumerator(line) is not None for line in lines)
        found["malformed role"] = len(D.malformed_roles(text))
    elif parser == "latex":
        found["visible argument"] = len(D.visible_arguments(text))
        found["open environment"] = len(D.environment_stack(text))
        found["extended text"] = len(latex_extra(text))
    elif parser in ("xhtml", "cnxml", "pretext"):
        found["well formed"] = int(D.well_formed(f"<_>{text}</_>"))
        found["elements"] = sum(1 for m in _MARKUP.finditer(text) if m["name"] and not m["close"])
    elif parser == "asciidoc":
        found["block style"] = sum(D.block_style(line) is not None for line in text.split("\n") if line.startswith("["))
    else:
        found["jsx tag"] = sum(D.jsx_tag(text, m.start()) is not None for m in re.finditer(r"<[A-Z]", text))
        found["shorthand"] = D.shorthand_links(text).count("](bikeshed:")
        for m in re.finditer(r"^(`{3,}|:{3,})\{glossary\}[^\n]*\n(.*?)^\1", text, re.MULTILINE | re.DOTALL):
            found["glossary entry"] = found.get("glossary entry", 0) + len(D.glossary_entries(m[2]))
    found["table"] = len(TABLES.get(parser, markdown_tables)(text))
    return {k: n for k, n in found.items() if n}


def adornments(text: str, start: int, end: int, title: str) -> list[tuple[int, int, str]]:
    """Edits that redraw the underline, and an overline, of a heading to the width of its new title."""
    edits = []
    below = re.compile(r"\n([ \t]*)([!-/:-@\[-`{-~])\2{2,}[ \t]*(?=\n|\Z)").match(text, text.find("\n", end) if "\n" in text[end:] else len(text))
    line = text.rfind("\n", 0, start) + 1
    above = re.compile(r"(?:\A|(?<=\n))([ \t]*)([!-/:-@\[-`{-~])\2{2,}[ \t]*\n\Z").search(text[:line]) if below else None
    if below:
        wide = max(3, display_width(title) + (2 if above and above[2] == below[2] and start > line else 0))
        edits.append((below.start() + 1, below.end(), below[1] + below[2] * wide))
        if above and above[2] == below[2]:
            edits.append((above.start(), above.end() - 1, above[1] + above[2] * wide))
    return edits
