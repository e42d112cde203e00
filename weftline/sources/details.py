"""Parts of document languages that stand on their own: table cells and grids, enumerators, skeletons, tags."""

from __future__ import annotations

import csv
import io
import re
from dataclasses import dataclass
from xml.parsers import expat

# --- AsciiDoc tables

_SPEC = re.compile(r"^(?:(?P<c>\d+)?(?:\.(?P<r>\d+))?(?P<op>[+*]))?(?P<a>[<^>]?(?:\.[<^>])?)(?P<s>[adehlmsv]?)$")


@dataclass
class CellSpec:
    columns: int = 1
    rows: int = 1
    repeat: int = 1
    style: str = ""


def cell_spec(token: str) -> CellSpec | None:
    """What stands before a cell's bar: 2+ and .2+ span, 3* repeats, a letter is the style. None if it is no specifier."""
    m = _SPEC.match(token.strip())
    if not m:
        return None
    columns, rows = int(m["c"] or 1), int(m["r"] or 1)
    return CellSpec(1, 1, columns, m["s"]) if m["op"] == "*" else CellSpec(columns, rows, 1, m["s"])


def declared_columns(attributes: str) -> int | None:
    """The number of columns of [cols=...]: a list, or a count with a star; None if it isn't declared."""
    m = re.search(r"""cols\s*=\s*(?:"([^"]*)"|'([^']*)'|([^,\]]+))""", attributes)
    if not m:
        return None
    total = 0
    for part in re.split(r"[,;]", next(g for g in m.groups() if g is not None)):
        star = re.match(r"\s*(\d+)\*", part)
        total += int(star[1]) if star else 1
    return total


def block_style(attributes: str) -> str | None:
    """The first positional attribute of a block attribute line."""
    m = re.match(r"^\[([\w-]+)?(?:[#.%][^,\]]*)*(?:,[^\]]*)?\]$", attributes.strip())
    return m[1] if m else None


def flow_cells(cells: list[tuple[CellSpec, str]], columns: int) -> list[list[str | None]]:
    """Rows of the grid that cells fill from the left, around the spans of earlier ones; covered places are None, the last row is filled up."""
    grid: list[list[str | None]] = []
    taken: set[tuple[int, int]] = set()
    row = column = 0
    for spec, text in cells:
        for _ in range(spec.repeat):
            while (row, column) in taken or column >= columns:
                row, column = (row + 1, 0) if column >= columns - 1 or column >= columns else (row, column + 1)
            while len(grid) <= row + spec.rows - 1:
                grid.append([None] * columns)
            grid[row][column] = text
            taken |= {(row + r, column + c) for r in range(spec.rows) for c in range(spec.columns)}
            column += spec.columns
    return grid


# --- reStructuredText

_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}


def roman(text: str) -> int | None:
    """The value of a well-formed roman numeral."""
    low = text.lower()
    if not re.fullmatch(r"m{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})", low) or not low:
        return None
    values = [_ROMAN[c] for c in low]
    return sum(-a if k + 1 < len(values) and a < values[k + 1] else a for k, a in enumerate(values))


def enumerator(text: str) -> tuple[str, int, int] | None:
    """(kind, value, length) of a list enumerator at the start of a line: 1. a) (iv) #. and so on. One letter that is also a numeral reads as a letter unless it is i."""
    m = re.match(r"(\()?(\d+|[A-Za-z]|[ivxlcdmIVXLCDM]+|#)([.)])(?=\s|$)", text)
    if not m or (m[1] and m[3] != ")"):
        return None
    body = m[2]
    if body == "#":
        return "auto", 0, m.end()
    if body.isdigit():
        return "arabic", int(body), m.end()
    if len(body) == 1 and body.lower() != "i":
        return "alpha", ord(body.lower()) - 96, m.end()
    value = roman(body)
    return ("roman", value, m.end()) if value else None


def list_table(body: str) -> list[list[str]]:
    """Rows of a list-table's content: a list of lists, continuation lines joined."""
    rows: list[list[str]] = []
    for line in body.split("\n"):
        if m := re.match(r"^\s*\* - ?(.*)$", line):
            rows.append([m[1].strip()])
        elif rows and (m := re.match(r"^\s+- ?(.*)$", line)):
            rows[-1].append(m[1].strip())
        elif rows and line.strip():
            rows[-1][-1] = (rows[-1][-1] + " " + line.strip()).strip()
    return rows


def csv_table(body: str, delimiter: str = ",") -> list[list[str]]:
    """Rows of a csv-table's content."""
    return [r for r in csv.reader(io.StringIO(body.strip("\n")), delimiter=delimiter, skipinitialspace=True) if r]


def malformed_roles(text: str) -> list[str]:
    """Roles whose backtick does not close before the line ends, or that a letter touches."""
    return [m[0] for m in re.finditer(r":[\w.+-]+:`[^`\n]*(?:$|`(?=[^\W_]))", text, re.MULTILINE)]


# --- LaTeX


def latex_cells(row: str) -> list[str]:
    """Cells of a table row: split at & outside braces and escapes, without the closing \\\\."""
    cells, depth, at, k = [], 0, 0, 0
    row = re.sub(r"\\\\(?:\[[^\]]*\])?\s*(?:\\hline)?\s*$", "", row)
    while k < len(row):
        if row[k] == "\\":
            k += 2
            continue
        depth += (row[k] == "{") - (row[k] == "}")
        if row[k] == "&" and depth == 0:
            cells.append(row[at:k].strip())
            at = k + 1
        k += 1
    return [*cells, row[at:].strip()]


def visible_arguments(text: str) -> list[tuple[str, int]]:
    """(argument, place) of commands whose argument a reader sees."""
    return [(m[1], m.start(1)) for m in re.finditer(r"\\(?:emph|textbf|textit|texttt|textsc|underline|footnote|caption|href\{[^{}]*\}|mbox|text)\{([^{}]*)\}", text)]


def environment_stack(text: str, stack: tuple[str, ...] = ()) -> tuple[str, ...]:
    """The open environments after the text."""
    out = list(stack)
    for m in re.finditer(r"\\(begin|end)\{([^}]*)\}", text):
        if m[1] == "begin":
            out.append(m[2])
        elif m[2] in out:
            while out.pop() != m[2]:
                pass
    return tuple(out)


# --- XML


def skeleton(source: str) -> str:
    """The structure with its text left out: elements with sorted attributes, in order. A source that is not well formed is an error."""
    out: list[str] = []
    reader = expat.ParserCreate()
    reader.StartElementHandler = lambda name, attrs: out.append("<" + name + "".join(f" {k}={v!r}" for k, v in sorted(attrs.items())) + ">")
    reader.EndElementHandler = lambda name: out.append(f"</{name}>")
    reader.Parse(source, True)
    return "".join(out)


def well_formed(source: str) -> bool:
    try:
        skeleton(source)
    except expat.ExpatError:
        return False
    return True


# --- MDX, MyST, Bikeshed


def jsx_tag(text: str, start: int) -> tuple[int, str, dict[str, str]] | None:
    """(end, name, attributes) of the JSX tag that opens at start; braces and quotes may hold angle brackets."""
    m = re.compile(r"</?([A-Za-z][\w.:-]*)").match(text, start)
    if not m:
        return None
    at, attributes = m.end(), {}
    part = re.compile(r"""\s*(?:([A-Za-z_][\w:-]*)(?:\s*=\s*("[^"]*"|'[^']*'|\{(?:[^{}]|\{[^{}]*\})*\}))?|(/?>)|\{(?:[^{}]|\{[^{}]*\})*\})""")
    while p := part.match(text, at):
        at = p.end()
        if p[3]:
            return at, m[1], attributes
        if p[1]:
            attributes[p[1]] = (p[2] or "").strip("\"'")
    return None


def glossary_entries(body: str) -> list[tuple[list[str], str]]:
    """Terms and definition of a glossary directive: unindented lines are terms, indented ones their definition."""
    found: list[tuple[list[str], str]] = []
    for line in body.split("\n"):
        if not line.strip():
            continue
        if not line[0].isspace():
            if found and not found[-1][1]:
                found[-1][0].append(line.strip())
            else:
                found.append(([line.strip()], ""))
        elif found:
            found[-1] = found[-1][0], (found[-1][1] + " " + line.strip()).strip()
    return found


def shorthand_links(source: str) -> str:
    """Autolinks and section references of the standards dialect as links that a Markdown scan keeps whole."""
    return re.sub(r"\[\[(#?[^\[\]\n|]+)\]\]", lambda m: f"[{m[1]}](bikeshed:{m[1]})", source)


def restore_shorthand(text: str) -> str:
    return re.sub(r"\[[^\[\]\n]*\]\(bikeshed:(#?[^()\n]+)\)", r"[[\1]]", text)


def validate_spans(source: bytes, spans: list[tuple[int, int]]) -> None:
    """Spans of a manifest must be ordered, apart, inside the source and at character boundaries; anything else is an error."""
    last = 0
    for a, b in spans:
        if not last <= a <= b <= len(source):
            raise ValueError(f"span {a}-{b} is out of order or out of bounds")
        for at in (a, b):
            if at < len(source) and source[at] & 0xC0 == 0x80:
                raise ValueError(f"span {a}-{b} cuts a character")
        last = b
