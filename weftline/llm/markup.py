"""Markup residue in text: what a field holds of HTML, Markdown, wiki and LaTeX, and its clean text.

Code blocks are cut out first, as nothing inside them counts. The standard library's streaming HTML
parser then gives events for tags, entities and comments; its text is scanned for TeX, wiki and
Markdown marks. `elements` reports every event, as every element that a text holds is asked for. For the
clean text each line's ratio of text to tags is smoothed with a Gaussian and split at a
threshold found by clustering; lines below it (menus, rows of links and buttons) that hold no heading, list, code or formula are
not content and are dropped.
"""

from __future__ import annotations

import functools
import html
import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The elements of HTML that count as markup, by kind; other names in angle brackets are text.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("ul ol li dl dt dd menu".split())
CODE_BLOCKS = frozenset("pre listing xmp".split())
OTHERS = frozenset("a abbr acronym address article aside audio b base bdi bdo big blockquote body br button canvas caption center cite code col colgroup data del details dfn div em embed fieldset figcaption figure font footer form frame head header hr html i iframe img input ins kbd label legend link main map mark meta nav noscript object optgroup option output p param picture progress q s samp script section select small source span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead time title tr track tt u var video wbr".split())
#: Elements of MathML, read as one formula.
MATH = frozenset("math".split())
#: Tags of the wiki engine: code, and the rest.
WIKI_CODE = frozenset("syntaxhighlight source".split())
WIKI_TAGS = frozenset("ref references nowiki gallery noinclude includeonly onlyinclude poem timeline score templatestyles section hiero inputbox indicator categorytree ce chem".split())
#: Elements whose text ends a line in the clean text.
BREAKS = HEADINGS | frozenset("p div br li ul ol tr table blockquote pre hr section article dt dd".split())
# Commands of LaTeX, by element. Commands with a braced argument count even when not listed here.
TEX_HEADINGS = "part|chapter|section|subsection|subsubsection|paragraph|subparagraph|title"
TEX_LISTS = "itemize|enumerate|description"
TEX_CODE = "verbatim|verbatim\\*|Verbatim|lstlisting|minted|alltt"
TEX_FORMULAS = "equation|align|gather|multline|eqnarray|displaymath|math|flalign|alignat|split|cases|[bBpvV]?matrix"

_FENCE = re.compile(r"^ {0,3}(?P<f>`{3,}(?=[^`\n]*$)|~{3,})[^\n]*\n(?P<body>.*?)(?:^ {0,3}(?P=f)[`~]*[ \t]*$|\Z)", re.DOTALL | re.MULTILINE)
_TEX_CODE = re.compile(r"\\begin\{(" + TEX_CODE + r")\}(?P<body>.*?)(?:\\end\{\1\}|\Z)", re.DOTALL)
_WIKI_CODE = re.compile(r"<(syntaxhighlight|source)\b(?=[^<>]*\blang\b|[^<>]*>[^<]*</\1)[^<>]*>(?P<body>.*?)(?:</\1\s*>|\Z)", re.DOTALL | re.IGNORECASE)
_HTML_CODE = re.compile(r"<(pre|listing|xmp)\b[^<>]*>(?P<body>.*?)(?:</\1\s*>|\Z)", re.DOTALL | re.IGNORECASE)
#: Where a code block may begin; each is read from there by the pattern of its kind, so a text is gone through once.
_CODE_BEGINS = re.compile(r"(?P<f>^ {0,3}(?:`{3}|~{3}))|(?P<t>\\begin\{(?:" + TEX_CODE + r")\})|(?P<w><(?:syntaxhighlight|source)\b)|(?P<h><(?:pre|listing|xmp)\b)", re.MULTILINE | re.IGNORECASE)
_WIKI_INDENTED = re.compile(r"<nowiki>(?P<body>.*?)</nowiki>", re.DOTALL | re.IGNORECASE)

_TEX_FORMULA = re.compile(
    r"\\begin\{(?P<e>(?:" + TEX_FORMULAS + r")\*?)\}.*?(?:\\end\{(?P=e)\}|\Z)"
    r"|\\\[.+?\\\]|\\\(.+?\\\)|(?<![\\$])\$\$(?!\s*\$).+?(?<!\\)\$\$"
    r"|(?<![\\$\w])\$(?![\s$])(?=[^$\n]*[A-Za-z\\^_=])[^$\n]*?(?<![\s\\])\$(?![\d$])",
    re.DOTALL,
)
_TEX_HEADING = re.compile(r"\\(?:" + TEX_HEADINGS + r")\*?\s*(?:\[[^\]]*\])?\{(?P<t>[^{}]*)\}")
_TEX_LIST = re.compile(r"\\(?:begin|end)\{(?:" + TEX_LISTS + r")\*?\}(?:\[[^\]]*\])?|\\item\b(?:\[[^\]]*\])?")
_TEX_OTHER = re.compile(r"~?\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{(?P<t>[^{}]*)\}|\{\\(?:em|bf|it|sc|tt|sl|sf|rm|small|large|itshape|bfseries)\b\s*(?P<u>[^{}]*)\}|\\(?:maketitle|tableofcontents|noindent|newline|newpage|clearpage|bigskip|medskip|smallskip|centering|par|ldots|dots|LaTeX|TeX)\b")
_TEX_NAMES = re.compile(r"\\(?:footnote|cite\w*|label|ref|eqref|pageref|index|bibliography)\*?")

_WIKI_HEADING = re.compile(r"^(?P<m>={1,6})(?!=)\s*(?P<t>[^\n]*?[^=\s\n])\s*(?P=m)[ \t]*$", re.MULTILINE)
_WIKI_LIST = re.compile(r"^(?:(?=#*[*:;])[*#:;]{2,}(?=[ \t]+\S)|[:;](?=[ \t]+[^\s:;)(|/]))", re.MULTILINE)
_SHARED_LIST = re.compile(r"^\*(?=[ \t]+\S)(?![ \t]*\*[ \t]*\*)", re.MULTILINE)
_WIKI_MATH = re.compile(r"\{\{\s*(?:math|mvar|tmath|frac|sfrac)\s*\|(?P<t>[^{}]*)\}\}|<math\b[^<>]*>(?P<u>[^<>]*)</math\s*>|<chem\b[^<>]*>(?P<v>[^<>]*)</chem\s*>", re.IGNORECASE)
_WIKI_TEMPLATE = re.compile(r"\{\{\s*[^\W\d][^{}|\n]*(?:\|(?P<t>[^{}]*))?\}\}")
_WIKI_LINK = re.compile(r"\[\[(?:[^\[\]|\n]*\|)?(?P<t>[^\[\]|\n]+)\]\]|\[(?:https?|ftp)://\S+ +(?P<u>[^\]\n]+)\](?!\()")
_WIKI_EMPHASIS = re.compile(r"(?<!')('{2,3}|'{5})(?!')(?P<t>[^'\n]+(?:'[^'\n]+)*)\1(?!')")
_WIKI_TABLE = re.compile(r"^\{\|.*?^\|\}", re.MULTILINE | re.DOTALL)
_WIKI_MAGIC = re.compile(r"__(?:NO)?TOC__|__FORCETOC__|__NOEDITSECTION__")

_MD_HEADING = re.compile(r"^ {0,3}#{1,6}[ \t]+(?P<t>[^\n]*?)[ \t]*#*[ \t]*$", re.MULTILINE)
_MD_SETEXT = re.compile(r"^(?P<t>[^\n|>#*+`~=-][^\n]*)\n {0,3}(?:={3,}|-{3,})[ \t]*$", re.MULTILINE)
_MD_LIST = re.compile(r"^ {0,3}(?:[-+]|\d{1,9}[.)])[ \t]+(?=\S)(?P<c>\[[ xX]\][ \t]+)?", re.MULTILINE)
_MD_QUOTE = re.compile(r"^ {0,3}>[ \t]?(?:\[!\w+\])?", re.MULTILINE)
_MD_TABLE = re.compile(r"^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)+\|?[ \t]*$", re.MULTILINE)
_MD_RULE = re.compile(r"^ {0,3}(?:\*[ \t]*){3,}$|^ {0,3}(?:_[ \t]*){3,}$|(?:(?<=\n\n)|\A) {0,3}-(?:[ \t]*-){2,}[ \t]*$", re.MULTILINE)
_MD_LINK = re.compile(r"!?\[(?P<t>[^\[\]\n]*)\]\((?!\))[^()\n]*(?:\([^()\n]*\)[^()\n]*)*\)|(?<![\w\]\[])!?\[(?P<u>[^\[\]\n]+)\]\[[^\[\]\n]*\]|^\[[^\]\n]+\]:[ \t]*\S+.*$|<https?://[^<>\s]+>", re.MULTILINE)
_MD_CODE = re.compile(r"(?<![`\\])(`{1,2})(?!`)(?P<t>[^`\n]+)\1(?!`)")
_MD_EMPHASIS = re.compile(
    r"(?<![\\*\w])(\*{1,3})(?![\s*])(?P<t>[^*\n]*?[^\s*\\])\1(?![\w*])"
    r"|(?<![\\_\w])(?!__[a-z_]+__)(_{1,3})(?![\s_])(?P<u>[^_\n]*?[^\s_\\])\3(?![\w_])"
    r"|(?<![~\\])~~(?![\s~])(?P<v>[^~\n]*?[^\s~])~~(?!~)"
)

#: Clean-text lines: standard deviation of the Gaussian, in lines, and rounds of the two-means split.
SIGMA, ROUNDS = 1.0, 12
#: Log ratios closer together than this form one cluster: then every line is content.
APART = 0.5
#: A line with so many characters a tag is running text with tags in it, whatever the clusters say.
PLAIN = 4.0
_MARK = "\x00{}\x01"


class _Reader(HTMLParser):
    """Collects the events of one text: found elements, and text with what stands for tags."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.found: set[tuple[str, str]] = set()
        self.text: list[str] = []
        self.tags: list[int] = []
        self.math = 0
        self.hidden = 0

    def _tag(self, name: str, raw: str, closing: bool) -> None:
        if name in MATH:
            self.math = max(0, self.math + (-1 if closing else 1))
            self.found.add(("html", "formula"))
        elif self.math:
            pass
        elif name in HEADINGS:
            self.found.add(("html", "heading"))
        elif name in LISTS:
            self.found.add(("html", "list"))
            if name == "li" and not closing:
                self._keep("\n" + _MARK_ITEM, raw)
                return
        elif name in CODE_BLOCKS:
            self.found.add(("html", "code"))
        elif name in WIKI_CODE and not closing and name != "source":
            self.found.add(("wiki", "code"))
        elif name in WIKI_TAGS and name != "section":
            self.found.add(("wiki", "other"))
        elif name in OTHERS:
            self.found.add(("html", "other"))
            if name in ("script", "style"):
                self.hidden = max(0, self.hidden + (-1 if closing else 1))
        else:
            self._keep(raw, "")
            return
        heading = name in HEADINGS
        self._keep("\n" + _MARK_HEAD if heading and not closing else "\n" if name in BREAKS else " " if name in ("td", "th") else "", raw)

    def _keep(self, text: str, raw: str) -> None:
        if not self.hidden:
            self.text.append(text)
        if raw:
            self.text.append("\x02")

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._tag(tag, self.get_starttag_text() or "", False)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self._tag(tag, self.get_starttag_text() or "", False)
        if tag in MATH:
            self.math -= 1

    def handle_endtag(self, tag: str) -> None:
        self._tag(tag, f"</{tag}>", True)

    def handle_data(self, data: str) -> None:
        self._keep(data, "")

    def handle_entityref(self, name: str) -> None:
        raw = f"&{name};"
        known = html.unescape(raw)
        if known != raw:
            if not self.math:
                self.found.add(("html", "other"))
            self._keep(known, "")
        else:
            self._keep(f"&{name}", "")

    def handle_charref(self, name: str) -> None:
        self.found.add(("html", "other"))
        self._keep(html.unescape(f"&#{name};"), "")

    def handle_comment(self, data: str) -> None:
        self.found.add(("html", "other"))
        self._keep("", f"<!--{data}-->")

    def handle_decl(self, decl: str) -> None:
        self.found.add(("html", "other"))
        self._keep("", f"<!{decl}>")

    def handle_pi(self, data: str) -> None:
        self._keep(f"<?{data}>", "")

    def unknown_decl(self, data: str) -> None:
        self._keep("", f"<![{data}]>")


class Markup:
    """One text taken apart: `found` holds (markup, element), `clean` the text."""

    def __init__(self, text: str | None) -> None:
        self.found: set[tuple[str, str]] = set()
        self.blocks: list[str] = []
        self._lines = ""
        if text and not text.isspace():
            self._read(text.replace("\r\n", "\n").replace("\x00", "").replace("\x01", "").replace("\x02", ""))

    def _stash(self, text: str) -> str:
        self.blocks.append(text)
        return _MARK.format(len(self.blocks) - 1)

    def _cut_code(self, text: str) -> str:
        """Replace each code block, whichever begins first, by a mark."""
        kinds = {"f": (_FENCE, "markdown"), "t": (_TEX_CODE, "latex"), "w": (_WIKI_CODE, "wiki"), "h": (_HTML_CODE, "html")}
        out, done = [], 0
        for opening in _CODE_BEGINS.finditer(text):
            kind = opening.lastgroup
            pattern, markup = kinds[kind]
            if opening.start() < done or not (m := pattern.match(text, opening.start())):
                continue
            self.found.add((markup, "code"))
            body = m["body"]
            if kind == "h":
                body = html.unescape(re.sub(r"</?[A-Za-z][^<>]*>", "", body))
            out += [text[done : m.start()], "\n", self._stash("```\n" + body.strip("\n") + "\n```"), "\n"]
            done = m.end()
        return "".join(out) + text[done:]

    def _sub(self, pattern: re.Pattern, kind: str, element: str, text: str, to) -> str:
        def one(m: re.Match) -> str:
            self.found.add((kind, element))
            return to(m)

        return pattern.sub(one, text)

    def _read(self, text: str) -> None:
        text = self._cut_code(text)
        inner = lambda m: next((g for g in (m.groupdict().get(k) for k in "tuv") if g), "")
        formula = lambda m: self._stash(m.group())
        text = self._sub(_TEX_FORMULA, "latex", "formula", text, formula)
        text = self._sub(_WIKI_MATH, "wiki", "formula", text, lambda m: self._stash("$" + inner(m).strip() + "$"))
        text = self._sub(_WIKI_INDENTED, "wiki", "other", text, lambda m: self._stash(m["body"]))
        # inline code before other marks: what it holds is literal
        text = self._sub(_MD_CODE, "markdown", "other", text, lambda m: self._stash(m["t"]))
        text = self._sub(_MD_LINK, "markdown", "other", text, inner)
        reader = _Reader()
        reader.feed(text)
        reader.close()
        self.found |= reader.found
        text = "".join(reader.text)
        # LaTeX
        text = self._sub(_TEX_HEADING, "latex", "heading", text, lambda m: f"\n{_MARK_HEAD}{m['t']}\n")
        text = self._sub(_TEX_LIST, "latex", "list", text, lambda m: f"{_MARK_ITEM}" if m.group().startswith("\\item") else "")
        text = self._sub(_TEX_OTHER, "latex", "other", text, lambda m: "" if _TEX_NAMES.match(m.group().lstrip("~")) else inner(m))
        # wiki
        text = self._sub(_WIKI_TABLE, "wiki", "other", text, lambda m: re.sub(r"^[|!]+[ \t]*", "", re.sub(r"^(?:\{\||\|\}|\|-|\|\+)[^\n]*$", "", m.group(), flags=re.MULTILINE), flags=re.MULTILINE))
        text = self._sub(_WIKI_HEADING, "wiki", "heading", text, lambda m: f"{_MARK_HEAD}{m['t']}")
        text = self._sub(_WIKI_TEMPLATE, "wiki", "other", text, lambda m: (m["t"] or "").rpartition("|")[2])
        text = self._sub(_WIKI_LINK, "wiki", "other", text, inner)
        text = self._sub(_WIKI_EMPHASIS, "wiki", "other", text, lambda m: m["t"])
        text = self._sub(_WIKI_MAGIC, "wiki", "other", text, lambda m: "")
        text = self._sub(_WIKI_LIST, "wiki", "list", text, lambda m: _MARK_ITEM)
        # Markdown
        text = self._sub(_MD_TABLE, "markdown", "other", text, lambda m: "")
        text = self._sub(_MD_RULE, "markdown", "other", text, lambda m: "")
        text = self._sub(_MD_HEADING, "markdown", "heading", text, lambda m: f"{_MARK_HEAD}{m['t']}")
        text = self._sub(_MD_SETEXT, "markdown", "heading", text, lambda m: f"{_MARK_HEAD}{m['t']}")
        text = self._sub(_MD_QUOTE, "markdown", "other", text, lambda m: "")
        shared = _SHARED_LIST.search(text)
        text = _SHARED_LIST.sub(_MARK_ITEM, text)
        text = self._sub(_MD_LIST, "markdown", "list", text, lambda m: _MARK_ITEM)
        text = self._sub(_MD_EMPHASIS, "markdown", "other", text, inner)
        if shared:
            self.found.add(("wiki" if any(k == "wiki" for k, _ in self.found) else "markdown", "list"))
        self._lines = text

    @functools.cached_property
    def clean(self) -> str:
        """The content lines, by smoothed ratio of characters to tags, with code and formulas put back."""
        lines = self._lines.split("\n")
        sizes = []
        for line in lines:
            tags = line.count("\x02")
            body = len(line.replace("\x02", "").strip())
            for m in re.finditer("\x00(\\d+)\x01", line):
                body += len(self.blocks[int(m[1])])
            sizes.append(body / max(1, tags))
        keep = content_lines(sizes)
        out = []
        for line, ok in zip(lines, keep):
            bare = line.replace("\x02", "")
            if ok or "\x00" in bare or _MARK_HEAD in bare or _MARK_ITEM in bare:
                bare = bare.replace(_MARK_HEAD, "# ").replace(_MARK_ITEM, "- ")
                bare = re.sub("\x00(\\d+)\x01", lambda m: self.blocks[int(m[1])], bare)
                out.append(re.sub(r"[ \t\xa0]+", " ", bare).strip() if "```" not in bare else bare.strip())
        return re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip()


_MARK_HEAD, _MARK_ITEM = "\x03", "\x04"


def content_lines(ratios: list[float]) -> list[bool]:
    """Which lines are content: log ratios smoothed with a Gaussian, split by two means; all are if there is no clear split."""
    values = [math.log1p(r) for r in ratios]
    reach = int(3 * SIGMA)
    kernel = [math.exp(-(d * d) / (2 * SIGMA * SIGMA)) for d in range(-reach, reach + 1)]
    smooth = []
    for i in range(len(values)):
        near = [(kernel[d + reach], values[i + d]) for d in range(-reach, reach + 1) if 0 <= i + d < len(values)]
        smooth.append(sum(k * v for k, v in near) / sum(k for k, _ in near))
    if not smooth:
        return []
    low, high = min(smooth), max(smooth)
    if high - low < APART:
        return [True] * len(ratios)
    for _ in range(ROUNDS):
        middle = (low + high) / 2
        a, b = [v for v in smooth if v <= middle], [v for v in smooth if v > middle]
        if not a or not b:
            break
        low, high = sum(a) / len(a), sum(b) / len(b)
    limit = (low + high) / 2
    return [v > limit or r >= PLAIN for v, r in zip(smooth, ratios)]


def elements(text: str | None) -> list[tuple[str, str]]:
    """The (markup, element) pairs that the text really holds, sorted; none for a null, empty or plain text."""
    return sorted(Markup(text).found)


def clean(text: str | None) -> str | None:
    """The text without markup, its headings, lists, code blocks and formulas kept; null stays null."""
    return None if text is None else Markup(text).clean


def _sides(blocks: DataFrame, key: str, sides: tuple[str, ...]) -> DataFrame:
    named = [F.struct(F.lit(s).alias("side"), F.col(s).cast("string").alias("text")) for s in sides]
    return blocks.select(F.col(key).alias("id"), F.explode(F.array(*named)).alias("s")).select("id", "s.side", "s.text").filter("text is not null")


def find_markup(blocks: DataFrame, key: str, sides: tuple[str, ...] = ("source", "translation")) -> DataFrame:
    """(key, side, markup, element) of each field; null and empty fields give no row, repeated rows repeated rows. Whole texts of any length; no shuffle. Other columns are dropped, so theirs can't clash."""
    kind = blocks.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, max(1, whole.num_rows), 1024):
                batch = whole.slice(at, 1024)
                rows = [(i, e) for i, t in enumerate(batch.column(2).to_pylist()) for e in elements(t)]
                which = pa.array([i for i, _ in rows], pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(which), batch.column(1).take(which), pa.array([e[0] for _, e in rows], pa.string()), pa.array([e[1] for _, e in rows], pa.string())], names=[key, "side", "markup", "element"])

    return _sides(blocks, key, sides).mapInArrow(run, f"`{key}` {kind}, side string, markup string, element string")


def clean_text(blocks: DataFrame, key: str, sides: tuple[str, ...] = ("source", "translation")) -> DataFrame:
    """(key, side, text): the clean text of each field that is not null."""
    kind = blocks.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, max(1, whole.num_rows), 1024):
                batch = whole.slice(at, 1024)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([clean(t) for t in batch.column(2).to_pylist()], pa.string())], names=[key, "side", "text"])

    return _sides(blocks, key, sides).mapInArrow(run, f"`{key}` {kind}, side string, text string")
