"""Document parsers: text to blocks with exact spans, blocks to segments, and back by splicing.

Every parser is a line or event scanner that yields blocks (type, span, level, offered). What no
block offers is left as it stands, so a document put together again without translations equals
its source byte for byte. Dialects are a Markdown scan behind a mask of equal length: what must not
be read as prose is blanked out first.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.includes import follow_titles
from weftline.functions.text import content_hash, normalize_inline, split_sentences
from weftline.sources import details as D
from weftline.sources import dialects as X

# The parser of each file extension; anything else is Markdown.
EXTENSIONS = {"rmd": "rmarkdown", "csv": "csv", "bs": "bikeshed", "adoc": "asciidoc", "rst": "rst", "tex": "latex", "mdx": "mdx", "xhtml": "xhtml", "cnxml": "cnxml", "ptx": "pretext"}
OPAQUE = frozenset(("code", "rule", "html"))


@dataclass
class Block:
    """A block of a document: characters start to end are its text."""

    kind: str
    start: int
    end: int
    level: int = 0
    offered: bool = True
    #: Texts of a grid's cells, where they are read apart from the lines they stand on.
    cells: tuple[str, ...] = ()


def _lines(text: str) -> list[tuple[int, int, str]]:
    """(start, end without the line break, body) of every line."""
    found, at = [], 0
    for line in text.split("\n"):
        found.append((at, at + len(line.rstrip("\r")), line.rstrip("\r")))
        at += len(line) + 1
    return found


def blank(text: str, spans: list[tuple[int, int]]) -> str:
    """text with the spans' characters, but for line breaks, replaced by NULs of the same number."""
    out, at = [], 0
    for a, b in sorted(spans):
        if a >= at:
            out += [text[at:a], re.sub(r"[^\n]", "\0", text[a:b])]
            at = b
    return "".join(out) + text[at:]


def _paragraphs(kind: str, run: list[tuple[int, int, str]], indent: int = 0) -> Block:
    first = run[0]
    skip = len(first[2]) - len(first[2].lstrip()) if not indent else indent
    return Block(kind, first[0] + skip, run[-1][1])


# --- Markdown and its dialects

_FENCE = re.compile(r"^\s{0,3}(`{3,}|~{3,})")
_ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+|$)(.*?)(?:[ \t]+#+)?(?:[ \t]*\{#[^}\n]*\})?[ \t]*$")
_ITEM = re.compile(r"^\s*(?:[-+*]|\d{1,9}[.)])[ \t]+(?:\[[ xX]\][ \t]+)?")
_QUOTE = re.compile(r"^ {0,3}(?:>[ \t]?)+(?:\[!\w+\][ \t]*$)?")
_RULE = re.compile(r"^ {0,3}([-*_])[ \t]*(?:\1[ \t]*){2,}$")
_TABLE_RULE = re.compile(r"^\s*\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)+\|?\s*$")
_HTML_LITERAL = re.compile(r"<(pre|code|script|style|textarea|svg|math)\b[^>]*>.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)|<\?.*?(?:\?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)", re.DOTALL | re.IGNORECASE)


_CONTAINER = re.compile(r"^[ \t]*(?:!!!|\?\?\?\+?|===)[ \t][^\n\"]*(?:\"(?P<title>[^\"\n]*)\")?")


def markdown(text: str, mask: Callable[[str], list[tuple[int, int]]] | None = None, containers: bool = False) -> list[Block]:
    """CommonMark with tables, task lists, alerts and front matter; mask gives ranges that hold no prose.

    Lines indented by four spaces after a blank one are code, but for what belongs to a list item or, with containers, to an admonition or tab.
    """
    seen = blank(text, mask(text)) if mask else text
    blocks: list[Block] = []
    run: list[tuple[int, int, str]] = []
    lines = _lines(seen)

    def close(kind: str = "paragraph") -> None:
        if run:
            blocks.append(_paragraphs(kind, run))
            run.clear()

    i, table, inner = 0, False, False
    if lines and lines[0][2].strip() == "---":
        end = next((k for k in range(1, len(lines)) if lines[k][2].strip() in ("---", "...")), None)
        if end:
            blocks.append(Block("code", 0, lines[end][1], offered=False))
            i = end + 1
    while i < len(lines):
        start, end, body = lines[i]
        if fence := _FENCE.match(body):
            close()
            mark = fence[1]
            last = next((k for k in range(i + 1, len(lines)) if lines[k][2].strip().startswith(mark) and not lines[k][2].strip().strip(mark[0])), len(lines) - 1)
            blocks.append(Block("code", start, lines[last][1], offered=False))
            i = last + 1
            continue
        bare = body.replace("\0", "")
        deep = re.match(r"(?: {4}|\t)\s*\S", body) is not None
        if bare.strip() and not deep:
            inner = bool(_ITEM.match(body)) or bool(run and inner) or (body[:1] in " \t" and inner)
        if containers and (opened := _CONTAINER.match(text[start:end])):
            close()
            if opened["title"]:
                blocks.append(Block("paragraph", start + opened.start("title"), start + opened.end("title")))
            i, inner = i + 1, True
            continue
        if not bare.strip():
            close()
            table = False
        elif deep and not run and not inner and not _ITEM.match(body):
            last = i
            while last + 1 < len(lines) and (not lines[last + 1][2].strip() or re.match(r"(?: {4}|\t)", lines[last + 1][2])):
                last += 1
            while not lines[last][2].strip():
                last -= 1
            blocks.append(Block("code", start, lines[last][1], offered=False))
            i = last + 1
            continue
        elif (head := _ATX.match(body)) and head[2].strip():
            close()
            blocks.append(Block("heading", start + head.start(2), start + head.end(2), len(head[1])))
        elif run and re.fullmatch(r" {0,3}(=+|-+)[ \t]*", body) and "\0" not in body:
            a, b = run[0][0], run[-1][1]
            run.clear()
            blocks.append(Block("heading", a + len(seen[a:b]) - len(seen[a:b].lstrip()), b, 1 if "=" in body else 2))
        elif _RULE.match(body):
            close()
            blocks.append(Block("rule", start, end, offered=False))
        elif "|" in body and (_TABLE_RULE.match(body) or (i + 1 < len(lines) and _TABLE_RULE.match(lines[i + 1][2])) or table):
            close()
            table = True
            if not _TABLE_RULE.match(body):
                for m in re.finditer(r"[^|]+", body):
                    cell = m.group().strip()
                    if cell and "\0" not in cell:
                        a = start + m.start() + len(m.group()) - len(m.group().lstrip())
                        blocks.append(Block("cell", a, a + len(cell)))
        elif re.match(r"^ {0,3}<(?:[A-Za-z/!?])", body) and not run:
            last = next((k for k in range(i, len(lines)) if not lines[k][2].strip()), len(lines))
            chunk = (start, lines[last - 1][1])
            blocks += [Block(b.kind, b.start + start, b.end + start, b.level, b.offered) for b in html_runs(seen[chunk[0] : chunk[1]])]
            i = last
            continue
        elif item := _ITEM.match(body):
            close()
            run.append((start + item.end(), end, body[item.end() :]))
            i += 1
            while i < len(lines) and lines[i][2].strip() and not _ITEM.match(lines[i][2]) and not _FENCE.match(lines[i][2]) and not _ATX.match(lines[i][2]) and not _QUOTE.match(lines[i][2]):
                run.append(lines[i])
                i += 1
            close("item")
            continue
        elif quote := _QUOTE.match(body):
            close()
            while i < len(lines) and (quote := _QUOTE.match(lines[i][2])):
                if lines[i][2][quote.end() :].strip():
                    run.append((lines[i][0] + (quote.end() if not run else 0), lines[i][1], lines[i][2][quote.end() :]))
                else:
                    close("quote")
                i += 1
            close("quote")
            continue
        else:
            run.append((start, end, body))
        i += 1
    close()
    return [b for b in blocks if b.end > b.start and (not b.offered or seen[b.start : b.end].replace("\0", "").strip())]


def _find(*patterns: str) -> Callable[[str], list[tuple[int, int]]]:
    compiled = [re.compile(p, re.DOTALL | re.MULTILINE) for p in patterns]
    return lambda text: _disjoint([m.span() for p in compiled for m in p.finditer(text)])


def _disjoint(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    found: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if not found or a >= found[-1][1]:
            found.append((a, b))
    return found


_DIRECTIVE = re.compile(r"^[ \t]*(?P<f>`{3,}|~{3,}|:{3,})\{(?P<n>[\w-]+)\}[^\n]*\n(?P<o>(?:[ \t]*:[\w-]+:[^\n]*\n)*)", re.MULTILINE)


def _myst(text: str) -> list[tuple[int, int]]:
    """Targets, comments, options, and the first and last line of directives whose content is prose."""
    spans = []
    for m in _DIRECTIVE.finditer(text):
        if m["n"] in _PROSE_DIRECTIVES:
            close = re.compile(rf"^[ \t]*{re.escape(m['f'])}[ \t]*$", re.MULTILINE).search(text, m.end())
            spans += [m.span(), *([close.span()] if close else [])]
    return _disjoint(spans + [x.span() for p in (r"^\([\w-]+\)=[ \t]*$", r"^:{3,}[^\n]*$", r"^%[^\n]*$", r"^\+\+\+[^\n]*$") for x in re.finditer(p, text, re.MULTILINE)])


def _mdx(text: str) -> list[tuple[int, int]]:
    """Imports and exports, component tags that stand at the begin of a line, on however many lines, and expressions on a line of their own."""
    spans = [m.span() for m in re.finditer(r"^(?:import|export)\s[^\n]*(?:\n(?!\s*\n)[^\n]*)*|^\{[^{}]*\}\s*$", text, re.MULTILINE)]
    for m in re.finditer(r"^[ \t]*(?=</?[A-Z])", text, re.MULTILINE):
        tag = D.jsx_tag(text, m.end())
        if tag and not text[tag[0] : text.find("\n", tag[0]) if "\n" in text[tag[0] :] else len(text)].strip():
            spans.append((m.start(), tag[0]))
    return _disjoint(spans)


#: What each dialect hides from the Markdown scan.
MASKS: dict[str, Callable[[str], list[tuple[int, int]]]] = {
    "mdx": _mdx,
    "myst": _myst,
    "mkdocs": _find(r"^\$\$.+?\$\$", r"^\\\[.+?\\\]", r"^--8<--[^\n]*$"),
    "rmarkdown": _find(r"^\$\$.+?\$\$", r"^\\begin\{(\w+)\}.+?\\end\{\1\}", r"^:::+[^\n]*$"),
    "bikeshed": _find(r"^<pre\b.+?</pre>", r"^(?:Title|Status|Shortname|Level|Group|URL|Editor|Abstract):[^\n]*$"),
    "markdeep": _find(r"^\*{5,}$.+?^\*{5,}$", r"<meta[^>]*>", r"<!--.*?-->"),
    "verso": _find(r"^#[\w-]+\s*$", r"^%%%.*?^%%%", r"^:::+[^\n]*$"),
}


# --- HTML and XML

_BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p section summary table tbody td tfoot th thead title tr ul para note example problem solution exercise item list entry row".split())
_HIDDEN = frozenset("pre code script style textarea svg math equation".split())


class _Runs(HTMLParser):
    """Runs of text between block tags, with their character spans."""

    def __init__(self, text: str) -> None:
        super().__init__(convert_charrefs=False)
        self.text, self.found, self.open, self.hidden, self.kind = text, [], None, 0, "paragraph"
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def at(self) -> int:
        line, column = self.getpos()
        return self.starts[line - 1] + column

    def cut(self, end: int) -> None:
        if self.open is not None:
            a = self.open
            body = self.text[a:end]
            bare = re.sub(r"<[^>]*>|&[#\w]+;", "", body)
            if any(c.isalnum() for c in bare):
                a += len(body) - len(body.lstrip())
                self.found.append(Block("heading" if self.kind[0] == "h" and self.kind[1:].isdigit() else "cell" if self.kind in ("td", "th") else "item" if self.kind == "li" else "paragraph", a, a + len(body.strip()), int(self.kind[1:]) if self.kind[1:].isdigit() else 0))
        self.open = None

    def _tag(self, tag: str, opening: bool, ends: int) -> None:
        if tag in _HIDDEN:
            if tag != "code" and tag != "math" or self.hidden or self.open is None:
                self.cut(self.at())
            self.hidden = max(0, self.hidden + (1 if opening else -1))
        elif tag in _BLOCK_TAGS:
            self.cut(self.at())
            self.kind = tag if opening else "paragraph"

    def handle_starttag(self, tag, attrs):
        self._tag(tag, True, 0)
        if self.open is None and not self.hidden and tag not in _BLOCK_TAGS and tag not in _HIDDEN:
            self.open = self.at()

    def handle_startendtag(self, tag, attrs):
        if tag in _BLOCK_TAGS:
            self.cut(self.at())

    def handle_endtag(self, tag):
        self._tag(tag, False, 0)

    def handle_data(self, data):
        if self.open is None and not self.hidden and data.strip():
            self.open = self.at()

    def handle_entityref(self, name):
        if self.open is None and not self.hidden:
            self.open = self.at()

    handle_charref = handle_entityref

    def handle_comment(self, data):
        self.cut(self.at())


def html_runs(text: str) -> list[Block]:
    """Runs of prose between block tags; comments and literal elements are no prose."""
    seen = blank(text, [m.span() for m in _HTML_LITERAL.finditer(text)]).replace("\0", " ")
    reader = _Runs(seen)
    reader.feed(seen)
    reader.close()
    reader.cut(len(seen))
    return reader.found


# --- AsciiDoc

_ADOC_FENCE = re.compile(r"^(-{4,}|\.{4,}|\+{4,}|/{4,}|`{3,})[ \t]*$")
_ADOC_ITEM = re.compile(r"^\s*(?:[*.\-]{1,5}|\d+\.)[ \t]+(?:\[[ x*]\][ \t]+)?|^\S[^\n]*?::[ \t]+(?=\S)")
_ADOC_META = re.compile(r"^(?:\[[^\n]*\]|:!?[\w-]+!?:[^\n]*|\.[^\s.][^\n]*|//[^\n]*|include::[^\n]*|ifdef::[^\n]*|endif::[^\n]*|ifndef::[^\n]*|image::[^\n]*|toc::[^\n]*|'''|<<<|={4,}|\*{4,}|_{4,}|--|\+)[ \t]*$")


def asciidoc(text: str) -> list[Block]:
    blocks: list[Block] = []
    run: list[tuple[int, int, str]] = []
    lines = _lines(text)

    def close(kind: str = "paragraph") -> None:
        if run:
            blocks.append(_paragraphs(kind, run))
            run.clear()

    i, table = 0, False
    while i < len(lines):
        start, end, body = lines[i]
        if fence := _ADOC_FENCE.match(body):
            close()
            last = next((k for k in range(i + 1, len(lines)) if lines[k][2].rstrip() == fence[1]), len(lines) - 1)
            blocks.append(Block("code", start, lines[last][1], offered=False))
            i = last + 1
            continue
        if re.match(r"^[|,:!]={3,}\s*$", body):
            close()
            table = not table
        elif table:
            for m in re.finditer(r"(?:^|(?<=\s))(?:\d*(?:\.\d+)?[+*])?[<^>]?[a-z]?\|([^|]*)", body):
                cell = m[1].strip()
                if cell:
                    a = start + m.start(1) + len(m[1]) - len(m[1].lstrip())
                    blocks.append(Block("cell", a, a + len(cell)))
        elif not body.strip():
            close()
        elif head := re.match(r"^(={1,6}|#{1,6})[ \t]+(\S.*?)[ \t]*$", body):
            close()
            blocks.append(Block("heading", start + head.start(2), start + head.end(2), len(head[1])))
        elif len(run) == 1 and re.fullmatch(r"[=\-~^+]{3,}", body) and abs(len(body) - len(run[0][2])) <= 2:
            blocks.append(Block("heading", run[0][0], run[0][1], "=-~^+".index(body[0]) + 1))
            run.clear()
        elif _ADOC_META.match(body):
            close()
            if body.startswith(".") and len(body) > 1 and body[1] not in ". ":
                blocks.append(Block("paragraph", start + 1, end))
        elif item := _ADOC_ITEM.match(body):
            close()
            run.append((start + item.end(), end, body[item.end() :]))
            i += 1
            while i < len(lines) and lines[i][2].strip() and not _ADOC_ITEM.match(lines[i][2]) and not _ADOC_META.match(lines[i][2]) and not _ADOC_FENCE.match(lines[i][2]):
                run.append(lines[i])
                i += 1
            close("item")
            continue
        else:
            admonition = re.match(r"^(?:NOTE|TIP|IMPORTANT|WARNING|CAUTION): +", body) if not run else None
            skip = admonition.end() if admonition else 0
            run.append((start + skip, end, body[skip:]))
        i += 1
    close()
    return [b for b in blocks if b.end > b.start]


# --- reStructuredText

_ADORN = re.compile(r"^([!-/:-@\[-`{-~])\1{2,}[ \t]*$")
_RST_ITEM = re.compile(r"^(\s*)(?:[-*+•]|(?:\d+|[A-Za-z]|#|[ivxlcdm]+)[.)]|\((?:\d+|[A-Za-z])\))[ \t]+(?=\S)")
_PROSE_DIRECTIVES = frozenset("note warning tip important caution attention danger error hint admonition seealso versionadded versionchanged deprecated topic sidebar epigraph highlights pull-quote rubric container".split())


def rst(text: str) -> list[Block]:
    blocks: list[Block] = []
    lines = _lines(text)
    levels: list[str] = []
    i, n = 0, len(lines)
    indent = lambda k: len(lines[k][2]) - len(lines[k][2].lstrip())

    def deeper(k: int, width: int) -> int:
        """The first line from k that is not blank and not indented past width."""
        while k < n and (not lines[k][2].strip() or indent(k) > width):
            k += 1
        return k

    def level(style: str) -> int:
        if style not in levels:
            levels.append(style)
        return levels.index(style) + 1

    while i < n:
        start, end, body = lines[i]
        bare = body.strip()
        if not bare:
            i += 1
        elif _ADORN.match(body) and i + 2 < n and lines[i + 1][2].strip() and _ADORN.match(lines[i + 2][2]) and lines[i + 2][2][0] == body[0]:
            a, b, t = lines[i + 1]
            blocks.append(Block("heading", a + len(t) - len(t.lstrip()), b, level("o" + body[0])))
            i += 3
        elif i + 1 < n and indent(i) == 0 and not _ADORN.match(body) and _ADORN.match(lines[i + 1][2]) and len(lines[i + 1][2].rstrip()) >= 3:
            blocks.append(Block("heading", start, start + len(body.rstrip()), level(lines[i + 1][2][0])))
            i += 2
        elif bare.startswith(".. ") or bare == "..":
            name = re.match(r"\.\. (?:\|[^|]*\| )?([\w:-]+)::[ \t]*(.*)$", bare)
            last = deeper(i + 1, indent(i))
            if name and name[1] in _PROSE_DIRECTIVES:
                if name[2]:
                    a = start + body.index(name[2], body.index("::") + 2)
                    blocks.append(Block("paragraph", a, a + len(name[2])))
                i += 1
                while i < last and (not lines[i][2].strip() or re.match(r"^\s+:[\w-]+:", lines[i][2])):
                    i += 1
            elif note := re.match(r"\.\. \[[^\]]+\][ \t]+", bare):
                a = start + indent(i) + note.end()
                stop = i + 1
                while stop < last and lines[stop][2].strip():
                    stop += 1
                blocks.append(Block("paragraph", a, lines[stop - 1][1]))
                i = stop
            else:
                blocks.append(Block("code", start, lines[last - 1][1] if last > i + 1 else end, offered=False))
                i = last
        elif re.match(r"^\s*\+[-=+]+\+\s*$", body):
            # a grid table: each run of text between bars is a line of a cell; cells of one line are offered
            last = i
            while last < n and re.match(r"^\s*[+|]", lines[last][2]):
                last += 1
            drawn = [lines[k][2].strip() for k in range(i, last)]
            grid = X.rst_grid(drawn) if X.is_plain_grid(drawn) else []
            if grid and len(grid) < sum(d.startswith("|") for d in drawn):
                # cells of several lines: offered as a whole, and drawn anew
                blocks.append(Block("grid", lines[i][0] + indent(i), lines[last - 1][1], cells=tuple(c for row in grid for c in row)))
                i = last
                continue
            for k in range(i, last):
                if "|" in lines[k][2] and re.match(r"^\s*[+|][-=+]*[+|]", lines[k - 1][2]) and k + 1 < n and re.match(r"^\s*\+[-=+]+\+", lines[k + 1][2]):
                    for m in re.finditer(r"[^|]+", lines[k][2]):
                        if X.cell_has_prose(cell := m.group().strip()):
                            a = lines[k][0] + m.start() + len(m.group()) - len(m.group().lstrip())
                            blocks.append(Block("cell", a, a + len(cell)))
            i = last
        elif re.match(r"^\s*=+(?:[ \t]+=+)+\s*$", body):
            edges = [m.span() for m in re.finditer("=+", body)]
            i += 1
            while i < n and lines[i][2].strip():
                if not re.match(r"^[\s=\-]+$", lines[i][2]):
                    for k, (a, _) in enumerate(edges):
                        b = edges[k + 1][0] if k + 1 < len(edges) else len(lines[i][2])
                        if X.cell_has_prose(cell := lines[i][2][a:b].strip()):
                            p = lines[i][0] + a + len(lines[i][2][a:b]) - len(lines[i][2][a:b].lstrip())
                            blocks.append(Block("cell", p, p + len(cell)))
                i += 1
        elif _ADORN.match(body):
            blocks.append(Block("rule", start, end, offered=False))
            i += 1
        elif re.match(r"^\s*(?:>>>|:[\w .-]+:(?:\s|$))", body):
            last = deeper(i + 1, indent(i)) if body.lstrip().startswith(":") else next((k for k in range(i, n) if not lines[k][2].strip()), n)
            blocks.append(Block("code", start, lines[last - 1][1], offered=False))
            i = max(last, i + 1)
        else:
            item = _RST_ITEM.match(body)
            skip = item.end() if item else indent(i)
            first, width = i, indent(i)
            i += 1
            while i < n and lines[i][2].strip() and not _RST_ITEM.match(lines[i][2]) and not (i + 1 < n and indent(i) == 0 and _ADORN.match(lines[i + 1][2]) and not item) and not lines[i][2].lstrip().startswith(".. "):
                i += 1
            a, b = start + skip, lines[i - 1][1]
            literal = text[a:b].rstrip().endswith("::")
            if text[a:b].strip() != "::":
                blocks.append(Block("item" if item else "quote" if width else "paragraph", a, b))
            if literal:
                last = deeper(i, width)
                if last > i and any(lines[k][2].strip() for k in range(i, last)):
                    blocks.append(Block("code", lines[i][0], lines[last - 1][1], offered=False))
                i = last
    return [b for b in blocks if b.end > b.start]


# --- LaTeX

_TEX_OPAQUE = re.compile(r"\\begin\{(verbatim\*?|Verbatim|lstlisting|minted|alltt|equation\*?|align\*?|gather\*?|multline\*?|eqnarray\*?|displaymath|tikzpicture|comment|filecontents)\}.*?(?:\\end\{\1\}|\Z)|(?<!\\)%[^\n]*|\\\[.*?\\\]|\$\$.*?\$\$", re.DOTALL)
_TEX_TITLE = re.compile(r"\\(part|chapter|section|subsection|subsubsection|paragraph|subparagraph|title|caption)\*?(?:\[[^\]]*\])?\{")
_TEX_LEVELS = ("part", "chapter", "section", "subsection", "subsubsection", "paragraph", "subparagraph")
_TEX_COMMAND = re.compile(r"\\(?:label|ref|eqref|cite\w*|documentclass|usepackage|input|include|bibliography\w*|includegraphics|newcommand|renewcommand|begin|end|index|pagestyle|setlength|vspace|hspace)\*?(?:\[[^\]]*\])*(?:\{[^{}]*\})*|\\[A-Za-z]+\*?|[{}&~]|\\\\")


def _braced(text: str, at: int) -> int:
    """The position of the brace that closes the one before `at`."""
    depth = 1
    for k in range(at, len(text)):
        depth += (text[k] == "{") - (text[k] == "}")
        if not depth:
            return k
    return len(text)


def latex(text: str) -> list[Block]:
    seen = blank(text, _disjoint([m.span() for m in _TEX_OPAQUE.finditer(text)]))
    blocks = [Block("code", m.start(), m.end(), offered=False) for m in _TEX_OPAQUE.finditer(text) if not m.group().startswith("%")]
    spans: list[tuple[int, int]] = []
    for m in _TEX_TITLE.finditer(seen):
        end = _braced(seen, m.end())
        if seen[m.end() : end].strip("\0 \n"):
            blocks.append(Block("heading" if m[1] not in ("title", "caption") else "paragraph", m.end(), end, _TEX_LEVELS.index(m[1]) + 1 if m[1] in _TEX_LEVELS else 0))
        spans.append((m.start(), end + 1))
    rest = blank(seen, _disjoint(spans))
    body = rest.find("\\begin{document}")
    at = body + len("\\begin{document}") if body >= 0 else 0
    for part in re.finditer(r"(?:(?!\n[ \t]*\n|\\item\b|\\begin\{[^}]*\}|\\end\{[^}]*\}|\0).|\n(?![ \t]*\n))+", rest[at:], re.DOTALL):
        chunk = part.group()
        a = at + part.start() + len(chunk) - len(chunk.lstrip())
        b = at + part.start() + len(chunk.rstrip())
        if any(c.isalpha() for c in _TEX_COMMAND.sub("", chunk)):
            before = rest[max(0, at + part.start() - 8) : at + part.start() + 8]
            label = re.match(r"\\item\b(?:\[[^\]]*\])?\s*", rest[a:b])
            blocks.append(Block("item" if label or "\\item" in before else "paragraph", a + (label.end() if label else 0), b))
        elif label := re.match(r"\\item", chunk):
            pass
    return sorted((b for b in blocks if b.end > b.start), key=lambda b: (b.start, b.end))


# --- CSV


def csv_fields(text: str) -> list[Block]:
    """Fields with a letter after the header record, by RFC 4180; a quoted field's span lies inside its quotes."""
    blocks: list[Block] = []
    at, row = 0, 0
    field = re.compile(r'"((?:[^"]|"")*)"|([^,\r\n"]*)')
    while at < len(text):
        m = field.match(text, at)
        span = m.span(1) if m[1] is not None else m.span(2)
        if row and any(c.isalpha() for c in text[slice(*span)]):
            blocks.append(Block("cell", *span))
        at = m.end()
        if at < len(text) and text[at] == ",":
            at += 1
        else:
            while at < len(text) and text[at] not in "\r\n":
                at += 1
            at += 2 if text[at : at + 2] == "\r\n" else 1
            row += 1
    return blocks


# --- dialects of other parsers


def vocabulary(name: str) -> Callable[[str], list[Block]]:
    """A parser of an XML vocabulary."""
    known = X.VOCABULARIES[name]
    return lambda text: [Block(*b) for b in X.xml_blocks(text, known)]


def rst_without(hidden: Callable[[str], list[tuple[int, int]]]) -> Callable[[str], list[Block]]:
    """reStructuredText without some ranges, which read as white space."""
    return lambda text: rst(blank(text, _disjoint(hidden(text))).replace("\0", " "))


def pep_text(text: str) -> list[Block]:
    """A proposal whose text blocks are prose, line by line."""
    lines = X.pep_text_lines(text)
    return rst_without(X.pep_hidden)(text) + [Block("paragraph", a, b) for a, b in lines]


def latex_extended(text: str) -> list[Block]:
    """LaTeX with titles of theorems, labels, boxes and reasons in formulas."""
    own = latex(text)
    offered = [b for b in own if b.offered]
    extra = [Block("paragraph", a, b) for a, b in X.latex_extra(text) if not any(o.start <= a and b <= o.end for o in offered)]
    return sorted(own + extra, key=lambda b: (b.start, b.end))


def manifest(text: str, spans: list[tuple[int, int, str]]) -> list[Block]:
    """Blocks that a manifest names by their UTF-8 bytes, (start, end, kind), for documents that only their own tool can read. Spans out of order, out of bounds or inside a character are an error."""
    raw = text.encode("utf-8", "surrogatepass")
    D.validate_spans(raw, [(a, b) for a, b, _ in spans])
    at = lambda n: len(raw[:n].decode("utf-8", "surrogatepass"))
    return [Block(kind, at(a), at(b), 1 if kind == "heading" else 0) for a, b, kind in spans if b > a]


PARSERS: dict[str, Callable[[str], list[Block]]] = {"markdown": markdown, "asciidoc": asciidoc, "rst": rst, "latex": latex, "csv": csv_fields, "xhtml": html_runs, "html": html_runs, "cnxml": vocabulary("cnxml"), "pretext": vocabulary("pretext"), "xhtml_strict": vocabulary("xhtml"), "pep": rst_without(X.pep_hidden), "pep_plaintext": rst_without(X.pep_plain_hidden), "pep_text": pep_text, "mathematics_in_lean": rst_without(X.lean_hidden), "latex_extended": latex_extended} | {name: (lambda t, m=mask, c=name == "mkdocs": markdown(t, m, c)) for name, mask in MASKS.items()}
ALIASES = {"tex": "latex", "md": "markdown", "mil": "mathematics_in_lean", "adoc": "asciidoc", "commonmark": "markdown"}


def parser_by_name(name: str) -> Callable[[str], list[Block]]:
    """The parser of a name or alias; an unknown name is an error."""
    key = ALIASES.get(name.lower(), name.lower())
    if key not in PARSERS:
        raise ValueError(f"no parser named {name}")
    return PARSERS[key]


def parser_column(path: Column) -> Column:
    """The parser's name by the file extension."""
    extension = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    table = F.create_map(*(F.lit(x) for kv in EXTENSIONS.items() for x in kv))
    return F.coalesce(F.try_element_at(table, extension), F.lit("markdown"))


@dataclass
class Segment:
    section: int
    block: int
    seg: int
    kind: str
    source: str
    start: int
    end: int
    cell: int = -1

    @property
    def id(self) -> str:
        return f"section:{self.section}/block:{self.block}/seg:{self.seg}"


def segments(text: str, blocks: list[Block]) -> list[Segment]:
    """Sentences of the offered blocks. Headings of level 1 and 2 open a section if the open one has blocks; opaque blocks take a number too."""
    found, section, block = [], 0, 0
    for b in sorted(blocks, key=lambda b: (b.start, b.end)):
        if b.kind == "heading" and b.level <= 2 and block:
            section, block = section + 1, 0
        if b.cells:
            parts = [(c, s) for c, cell in enumerate(b.cells) if X.cell_has_prose(cell) for s in split_sentences(normalize_inline(cell))]
            found += [Segment(section, block, k, "cell", s, b.start, b.end, c) for k, (c, s) in enumerate(parts)]
        elif b.offered and b.kind not in OPAQUE:
            for k, s in enumerate(split_sentences(normalize_inline(text[b.start : b.end]))):
                found.append(Segment(section, block, k, b.kind, s, b.start, b.end))
        block += 1
    return found


def splice(text: str, edits: list[tuple[int, int, str]]) -> str:
    """text with ranges replaced, in order of their start; an edit that begins inside an earlier one is skipped."""
    out, at = [], 0
    for a, b, new in sorted(edits, key=lambda e: e[:2]):
        if a >= at:
            out += [text[at:a], new]
            at = b
    return "".join(out) + text[at:]


def reconstruct(text: str, found: list[Segment], translations: dict[str, str], parser: str = "markdown") -> str:
    """The document with its translated blocks; an untranslated sentence of such a block falls back to its source.

    Title underlines of reStructuredText and AsciiDoc are redrawn to the width of the new title, and references to titles follow them; attributes of XML are escaped.
    """
    by: dict[tuple[int, int], list[Segment]] = {}
    for s in found:
        by.setdefault((s.start, s.end), []).append(s)
    edits = []
    joined = lambda group: " ".join(translations.get(s.id, s.source) for s in group)
    titles = {text[a:b]: joined(g) for (a, b), g in by.items() if g[0].kind == "heading" and any(s.id in translations for s in g)} if parser in ("rst", "pep") else {}
    for (a, b), group in by.items():
        if group[0].cell >= 0:
            if any(s.id in translations for s in group):
                texts: dict[int, list[Segment]] = {}
                for s in group:
                    texts.setdefault(s.cell, []).append(s)
                edits.append((a, b, X.redrawn(text[a:b], text[text.rfind("\n", 0, a) + 1 : a], {c: follow_titles(joined(g), titles) for c, g in texts.items()})))
            continue
        new = follow_titles(joined(group), titles)
        # an untranslated block is touched only if it refers to a title that was
        if not any(s.id in translations for s in group) and (not titles or follow_titles(text[a:b], titles) == text[a:b]):
            continue
        if group[0].kind == "attribute":
            new = X.escape_attribute(new)
        elif group[0].kind == "heading" and parser in ("rst", "asciidoc", "pep"):
            edits += X.adornments(text, a, b, new)
        edits.append((a, b, new))
    return splice(text, edits)


def parse_documents(documents: DataFrame, key: str, text: str, parser: Column) -> DataFrame:
    """(key, section, block, seg, kind, source, source_hash, start, end) of every segment; start and end count UTF-8 bytes.

    A null text or an unknown parser gives no rows. One document is read by one task, streamed in Arrow batches.
    """
    kind = documents.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, section int, block int, seg int, kind string, source string, source_hash decimal(20,0), start bigint, end bigint"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from decimal import Decimal

        for batch in batches:
            rows = []
            for k, t, name in zip(batch["k"], batch["t"], batch["p"]):
                key_ = ALIASES.get(name or "", name or "")
                if t is None or key_ not in PARSERS:
                    continue
                ends = None if t.isascii() else [0, *_running_bytes(t)]
                for s in segments(t, PARSERS[key_](t)):
                    a, b = (s.start, s.end) if ends is None else (ends[s.start], ends[s.end])
                    rows.append((k, s.section, s.block, s.seg, s.kind, s.source, Decimal(content_hash(s.source)), a, b))
            yield pd.DataFrame(rows, columns=[key, "section", "block", "seg", "kind", "source", "source_hash", "start", "end"])

    return documents.select(F.col(key).alias("k"), F.col(text).alias("t"), F.lower(parser).alias("p")).mapInPandas(run, schema)


def _running_bytes(text: str) -> list[int]:
    total, out = 0, []
    for c in text:
        total += len(c.encode("utf-8", "surrogatepass"))
        out.append(total)
    return out


def round_trips(documents: DataFrame, key: str, text: str, parser: Column) -> DataFrame:
    """(key, same, spans_hold): whether the document without translations is itself, and whether every block's span holds the words of its segments. An unknown parser reads nothing, which leaves the text as it is."""
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, t, name in zip(batch["k"], batch["t"], batch["p"]):
                parse = PARSERS.get(ALIASES.get(name or "", name or ""))
                found = segments(t, parse(t)) if parse else []
                same = reconstruct(t, found, {}) == t
                by: dict[tuple[int, int], list[str]] = {}
                for s in (s for s in found if s.cell < 0):
                    by.setdefault((s.start, s.end), []).append(s.source)
                rows.append((k, same, all(" ".join(v).split() == normalize_inline(t[a:b]).split() for (a, b), v in by.items())))
            yield pd.DataFrame(rows, columns=[key, "same", "spans_hold"])

    return documents.select(F.col(key).alias("k"), F.col(text).alias("t"), F.lower(parser).alias("p")).mapInPandas(run, f"`{key}` {kind}, same boolean, spans_hold boolean")


def _rows(documents: DataFrame, key: str, text: str, parser: Column, schema: str, read: Callable[[str, str], list[tuple]]) -> DataFrame:
    """(key, ...) of what read gives for each text and its parser's name; null texts give nothing."""
    kind = documents.schema[key].dataType.simpleString()
    columns = [key, *(c.split()[0] for c in schema.split(", "))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, *r) for k, t, name in zip(batch["k"], batch["t"], batch["p"]) if t is not None for r in read(t, ALIASES.get(name or "", name or ""))]
            yield pd.DataFrame(rows, columns=columns)

    return documents.select(F.col(key).alias("k"), F.col(text).alias("t"), F.lower(parser).alias("p")).mapInPandas(run, f"`{key}` {kind}, {schema}")


def document_tables(documents: DataFrame, key: str, text: str, parser: Column) -> DataFrame:
    """(key, table_no, row_no, column_no, cell) of the tables of each document, read as grids; places covered by a span are empty."""

    def read(t: str, name: str) -> list[tuple]:
        return [(n, i, j, c) for n, grid in enumerate(X.TABLES.get(name, X.markdown_tables)(t)) for i, row in enumerate(grid) for j, c in enumerate(row)]

    return _rows(documents, key, text, parser, "table_no int, row_no int, column_no int, cell string", read)


def document_constructs(documents: DataFrame, key: str, text: str, parser: Column) -> DataFrame:
    """(key, construct, n): constructs that the document's parser reads apart."""
    return _rows(documents, key, text, parser, "construct string, n int", lambda t, name: sorted(X.constructs(t, name).items()))


def rebuilt(documents: DataFrame, key: str, text: str, parser: Column) -> DataFrame:
    """(key, segments, kept): each document with every sentence put in capitals, put together and parsed again; how many sentences come back as they were put in."""

    def read(t: str, name: str) -> list[tuple]:
        if name not in PARSERS:
            return []
        found = segments(t, PARSERS[name](t))
        again = segments(out := reconstruct(t, found, {s.id: s.source for s in found}, name), PARSERS[name](out))
        return [(len(found), sum(a.source == b.source for a, b in zip(found, again)))]

    return _rows(documents, key, text, parser, "segments int, kept int", read)


def line_maps(documents: DataFrame, key: str, source: str, translated: str, parser: Column) -> DataFrame:
    """(key, line, to_line): where each line of a source stands in its translation; a pair whose blocks do not go together gives none."""
    from weftline.functions.includes import LineMap

    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, a, b, name in zip(batch["k"], batch["a"], batch["b"], batch["p"]):
                parse = PARSERS.get(ALIASES.get(name or "", name or ""))
                if a is None or b is None or parse is None:
                    continue
                known = LineMap.between(a, [(x.kind, x.start, x.end) for x in parse(a)], b, [(x.kind, x.start, x.end) for x in parse(b)])
                if known is not None:
                    rows += [(k, n, known.line(n)) for n in range(a.count("\n") + 1)]
            yield pd.DataFrame(rows, columns=[key, "line", "to_line"])

    return documents.select(F.col(key).alias("k"), F.col(source).alias("a"), F.col(translated).alias("b"), F.lower(parser).alias("p")).mapInPandas(run, f"`{key}` {kind}, line int, to_line int")
