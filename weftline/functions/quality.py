"""Mechanical quality of a rendering against its source: links, code, emphasis, parentheses, register; repairs; inline tags."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from weftline.functions import formats as M
from weftline.functions import text as X

# --- inline scanners

_CODE = re.compile(r"(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)", re.DOTALL)
_MATH = re.compile(r"\$\$.+?\$\$|(?<![\\\w$])\$(?=\S)[^$\n]+?(?<=\S)\$(?!\d)|\\\(.+?\\\)|\\\[.+?\\\]", re.DOTALL)


def code_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, content) of inline code, closed by a run of backticks of the same length."""
    return [(m.start(), m.end(), m[2].strip()) for m in _CODE.finditer(text)]


def mark_runs(text: str, mark: str) -> int:
    """Runs of a mark, each counted once."""
    return len(re.findall(re.escape(mark) + "+", text))


def without_reference_labels(text: str) -> str:
    """[a][b] reads as [a]."""
    return re.sub(r"\]\[[^\[\]]*\]", "]", text)


def _punctuation(c: str) -> bool:
    return not c.isalnum() and not c.isspace()


def flanks(before: str, after: str) -> bool:
    """Whether a delimiter run is left-flanking; with swapped arguments, right-flanking. An empty neighbour is an end of the text."""
    if not after or after.isspace():
        return False
    return not _punctuation(after) or not before or before.isspace() or _punctuation(before)


@dataclass
class _Run:
    at: int
    size: int
    mark: str
    opens: bool
    closes: bool
    left: int


def emphasis(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """Pairs that form, as (start, end, marks), and runs left as text where one could open or close, by the delimiter rules of CommonMark; code is skipped."""
    seen = text
    for a, b, _ in code_spans(text):
        seen = seen[:a] + "x" * (b - a) + seen[b:]
    seen = re.sub(r"\\[*_]", "xx", seen)
    runs: list[_Run] = []
    for m in re.finditer(r"\*+|_+", seen):
        before, after = seen[m.start() - 1 : m.start()] if m.start() else "", seen[m.end() : m.end() + 1]
        lf, rf = flanks(before, after), flanks(after, before)
        if m[0][0] == "*":
            opens, closes = lf, rf
        else:
            opens = lf and (not rf or (bool(before) and _punctuation(before)))
            closes = rf and (not lf or (bool(after) and _punctuation(after)))
        runs.append(_Run(m.start(), len(m[0]), m[0][0], opens, closes, len(m[0])))
    pairs, stack = [], []
    for run in runs:
        if run.closes:
            while run.left:
                k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k].mark == run.mark and stack[k].left and not ((stack[k].closes or run.opens) and (stack[k].size + run.size) % 3 == 0 and (stack[k].size % 3 or run.size % 3))), None)
                if k is None:
                    break
                opener = stack[k]
                n = 2 if opener.left >= 2 and run.left >= 2 else 1
                pairs.append((opener.at + opener.left - n, run.at + run.size - run.left + n, n))
                opener.left -= n
                run.left -= n
                del stack[k + 1 :]
                if not opener.left:
                    del stack[k]
        if run.opens and run.left:
            stack.append(run)
    stray = [(r.at, r.at + r.size) for r in runs if r.left == r.size and (r.opens or r.closes or _blocked(seen, r))]
    return sorted(pairs), stray


def _blocked(seen: str, run: _Run) -> bool:
    """A run that touches text on either side but may neither open nor close there."""
    before, after = seen[run.at - 1 : run.at] if run.at else "", seen[run.at + run.size : run.at + run.size + 1]
    inside_word = run.mark == "_" and before.isalnum() and after.isalnum()
    return (flanks(before, after) or flanks(after, before)) and not inside_word


def prose_parentheses(text: str) -> tuple[list[tuple[int, int]], bool]:
    """Pairs outside code and formulas, and whether all are paired."""
    hidden = [(a, b) for a, b, _ in code_spans(text)] + [m.span() for m in _MATH.finditer(text)]
    stack, pairs, balanced = [], [], True
    for m in re.finditer(r"[()]", text):
        at = m.start()
        if any(a <= at < b for a, b in hidden):
            continue
        if m[0] == "(":
            stack.append(at)
        elif stack:
            pairs.append((stack.pop(), at))
        else:
            balanced = False
    return sorted(pairs), balanced and not stack


def doubled_parentheses(text: str) -> list[str]:
    pairs = set(prose_parentheses(text)[0])
    return [text[a : b + 1] for a, b in sorted(pairs) if (a + 1, b - 1) in pairs]


def latex_tokens(text: str) -> list[str]:
    """Commands, braces and alignment marks, outside comments."""
    return re.findall(r"\\[A-Za-z]+\*?|\\.|[{}&~]", re.sub(r"(?<!\\)%[^\n]*", "", text))


def latex_balance(tokens: list[str]) -> tuple[int, int]:
    return tokens.count("{"), tokens.count("}")


_LINE_START = (("heading", r"#{1,6}\s"), ("list", r"(?:[-+*]|\d+[.)])\s"), ("quote", r">"), ("table", r"\|"), ("fence", r"```|~~~"))


def line_start_construct(text: str) -> str | None:
    """The construct that the first characters of a line would open."""
    return next((name for name, p in _LINE_START if re.match(p, text)), None)


# --- evaluators: each gives the issues of one pair


def link_issues(source: str, rendering: str, markup: str = "markdown") -> list[str]:
    """Every address of the source must occur; relative targets and code labels must occur as often."""
    bracket = markup == "asciidoc"
    theirs = set(X.extract_urls(rendering, bracket))
    issues = [f"link {u} is missing" for u in dict.fromkeys(X.extract_urls(source, bracket)) if u not in theirs]
    if markup in ("markdown", "mdx", "myst", "mkdocs", "rmarkdown"):
        issues += [f"link target {d} is missing" for d in X.multiset_difference(X.markdown_destinations(source), X.markdown_destinations(rendering))]
        issues += [f"reference {d} is missing" for d in X.multiset_difference(X.code_reference_labels(source), X.code_reference_labels(rendering))]
    if markup == "rst":
        issues += [f"reference {d} is missing" for d in X.multiset_difference(X.rst_named_references(source), X.rst_named_references(rendering))]
        if X.rst_anonymous_references(source) != X.rst_anonymous_references(rendering):
            issues.append("the number of anonymous references differs")
    return issues


def format_issues(source: str, rendering: str, markup: str = "markdown") -> list[str]:
    """Code, formulas, emphasis and line starts must be kept."""
    issues = []
    ours, theirs = [c for *_, c in code_spans(source)], [c for *_, c in code_spans(rendering)]
    lost, spare = M.unmatched_code(ours, theirs)
    issues += [f"code {c} is missing" for c in lost]
    issues += [f"code {c} is new" for c in spare if not M.written_as_text(source, c)]
    if markup in ("latex", "mkdocs", "rmarkdown", "myst"):
        issues += [f"formula {f} is missing" for f in X.multiset_difference(_MATH.findall(source), _MATH.findall(rendering))]
    if markup == "latex":
        opened, closed = latex_balance(latex_tokens(rendering))
        if opened != closed and latex_balance(latex_tokens(source))[0] == latex_balance(latex_tokens(source))[1]:
            issues.append("braces do not balance")
        issues += [f"command {t} is missing" for t in X.multiset_difference([t for t in latex_tokens(source) if len(t) > 1], latex_tokens(rendering))]
    elif markup not in ("asciidoc", "rst", "xhtml"):
        (a, _), (b, stray) = emphasis(without_reference_labels(source)), emphasis(without_reference_labels(rendering))
        if len(b) < len(a):
            issues.append(f"{len(a) - len(b)} emphasis pairs are missing" + (", marks are blocked" if stray else ""))
    issues += M.markup_issues(source, rendering, markup)
    if markup == "rmarkdown":
        issues += [f"token {t} is missing" for t in X.multiset_difference(X.preserved_tokens(source), X.preserved_tokens(rendering))]
    if (new := line_start_construct(rendering)) and new != line_start_construct(source):
        issues.append(f"the first characters open a {new}")
    return issues


def parenthesis_issues(source: str, rendering: str) -> list[str]:
    if len(doubled_parentheses(rendering)) > len(doubled_parentheses(source)):
        return ["parentheses are doubled"]
    if prose_parentheses(source)[1] and source.count("(") == source.count(")") and not prose_parentheses(rendering)[1]:
        return ["parentheses do not balance"]
    return []


def ending_issues(source: str, rendering: str, target: str = "ko") -> list[str]:
    """Only for Korean, and only if the source ends in a full stop."""
    if not target.startswith("ko") or not source.rstrip().endswith("."):
        return []
    return [f"ending {e} leaves the register" for e in X.off_register_endings(rendering)]


def token_issues(source: str, rendering: str) -> list[str]:
    """Autolinks and variables of the standards dialect must be the same multiset."""
    a, b = Counter(X.bikeshed_tokens(source)), Counter(X.bikeshed_tokens(rendering))
    return [f"token {t} differs" for t in sorted((a - b) + (b - a))]


def evaluate(source: str, rendering: str, markup: str = "markdown", target: str = "ko") -> list[str]:
    """All issues; none means passed."""
    found = link_issues(source, rendering, markup) + format_issues(source, rendering, markup) + parenthesis_issues(source, rendering) + ending_issues(source, rendering, target)
    return found + (token_issues(source, rendering) if markup == "bikeshed" else [])


# --- repairs


def repair_emphasis(source: str, rendering: str) -> str:
    """Where marks are blocked between punctuation and a letter, the punctuation moves out of the emphasis or stars take the place of underscores, if more pairs form that way."""
    want = len(emphasis(source)[0])
    if len(emphasis(rendering)[0]) >= want:
        return rendering
    best = rendering
    for change in (
        lambda t: re.sub(r"(?<![\w_])_([^_\n]+)_(?=[가-힣])", r"*\1*", t),
        lambda t: re.sub(r"(\*{1,2})([^*\n]+?)([.,;:!?)\"'”’]+)\1(?=[가-힣A-Za-z])", r"\1\2\1\3", t),
        lambda t: re.sub(r"(?<=[가-힣A-Za-z])(\*{1,2})([(\"'“‘]+)([^*\n]+?)\1", r"\2\1\3\1", t),
    ):
        tried = change(best)
        if len(emphasis(tried)[0]) > len(emphasis(best)[0]):
            best = tried
    return best


def repair_rst(rendering: str) -> str:
    """An escaped space between inline markup and a letter that touches it."""
    text = re.sub(r"(``[^`\n]+``|(?<![`:\w])`[^`\n]+`_{0,2}|(?<!\*)\*\*[^*\n]+\*\*)(?=[가-힣A-Za-z0-9])", r"\1\\ ", rendering)
    return re.sub(r"(?<=[가-힣A-Za-z0-9])(?=``[^`\n]+``)", r"\\ ", text)


def repair_asciidoc(rendering: str) -> str:
    """Constrained marks doubled where a word touches them."""
    for mark, pattern in M.CONSTRAINED.items():
        rendering = pattern.sub(lambda m, c=mark: f"{c * 2}{m[1]}{c * 2}{m['after']}" if m["after"] and (m["after"].isalnum() or m["after"] in "_\"'") else m[0], rendering)
    return rendering


def repair_citations(rendering: str) -> str:
    """@key glued to a letter of another script gets braces."""
    return re.sub(r"(?<![\w@{])@([A-Za-z][\w:.-]*[A-Za-z0-9])(?=[가-힣])", r"@{\1}", rendering)


def repair(markup: str, source: str, rendering: str) -> str:
    if markup == "rst":
        return repair_rst(rendering)
    if markup == "asciidoc":
        return repair_asciidoc(rendering)
    if markup == "verso":
        return M.restore_verso(source, rendering)
    if markup == "rmarkdown":
        rendering = repair_citations(rendering)
    return repair_emphasis(source, rendering) if markup not in ("latex", "xhtml") else rendering


def constructs(text: str) -> Counter:
    """How many of each inline construct of Markdown a text holds; code is left to its own rules."""
    bare = text
    for a, b, _ in code_spans(text):
        bare = bare[:a] + "x" * (b - a) + bare[b:]
    found = Counter({1: "italic", 2: "bold"}[n] for *_, n in emphasis(text)[0])
    found["image"] = len(re.findall(r"!\[[^\[\]\n]*\](?:\(|\[)", bare))
    found["link"] = len(re.findall(r"(?<!!)\[(?!\^)[^\[\]\n]+\](?:\([^()\n]*\)|\[[^\[\]\n]*\])", bare))
    found["footnote reference"] = len(re.findall(r"\[\^[^\[\]\s]+\](?!:)", bare))
    found["autolink"] = len(re.findall(r"<https?://[^<>\s]+>", bare))
    found["inline HTML"] = len(re.findall(r"</?[A-Za-z][^<>\n:]*>", bare))
    found["strikethrough"] = len(re.findall(r"(?<!~)~~(?!~)[^~\n]+~~(?!~)", bare))
    return +found


def construct_issues(source: str, rendering: str, markup: str = "markdown") -> list[str]:
    """Only what concerns inline markup: code, formulas, emphasis and the markup's own pairs; and of Markdown every construct that the rendering has fewer of."""
    issues = format_issues(source, rendering, markup)
    if markup in ("markdown", "mdx", "myst", "mkdocs", "rmarkdown", "markdeep"):
        want, got = constructs(source), constructs(rendering)
        issues += [f"{name} {got[name]} of {n}" for name, n in sorted(want.items()) if got[name] < n and name not in ("italic", "bold")]
    return issues


# --- inline tags

_TAGGED = re.compile(r"<(/?)g(\d+)>|<x(\d+)/>")


def tagify(source: str) -> tuple[str, list[tuple[str, str]]]:
    """Text with numbered tags for its markup, and the (opening, closing) marks of each; marks that stand alone have no closing one."""
    marks: list[tuple[int, int, int | None, int | None]] = []
    taken: list[tuple[int, int]] = [(a, b) for a, b, _ in code_spans(source)]
    alone = list(taken)
    for m in re.finditer(r"(!?)\[([^\[\]\n]*)\](\([^()\n]*\)|\[[^\[\]\n]*\])", source):
        if any(a < m.end() and m.start() < b for a, b in taken):
            continue
        if m[1]:
            alone.append(m.span())
            taken.append(m.span())
        else:
            marks.append((m.start(), m.start() + 1, m.end(2), m.end()))
    for m in re.finditer(r"<[A-Za-z/][^<>\n]*>", source):
        if not any(a < m.end() and m.start() < b for a, b in taken):
            alone.append(m.span())
            taken.append(m.span())
    for a, b, n in emphasis(source)[0]:
        marks.append((a, a + n, b - n, b))
    edges = [(a, b, "open", k) for k, (a, b, _, _) in enumerate(marks)] + [(c, d, "close", k) for k, (_, _, c, d) in enumerate(marks)]
    edges += [(a, b, "alone", None) for a, b in alone]
    tags: list[tuple[str, str]] = []
    number: dict[int, int] = {}
    out, at = [], 0
    for a, b, kind, k in sorted(edges, key=lambda e: (e[0], e[1])):
        if a < at:
            continue
        out.append(source[at:a])
        if kind == "alone":
            tags.append((source[a:b], ""))
            out.append(f"<x{len(tags)}/>")
        elif kind == "open":
            _, _, c, d = marks[k]
            tags.append((source[a:b], source[c:d]))
            number[k] = len(tags)
            out.append(f"<g{len(tags)}>")
        elif k in number:
            out.append(f"</g{number[k]}>")
        at = b
    return "".join(out) + source[at:], tags


def tag_problems(reply: str, tags: list[tuple[str, str]]) -> list[str]:
    """Tags that are missing, repeated, unknown or not nested."""
    problems, stack, seen = [], [], Counter()
    for m in _TAGGED.finditer(reply):
        n = int(m[2] or m[3])
        if not 1 <= n <= len(tags):
            problems.append(f"tag {n} is unknown")
        elif m[3] or not m[1]:
            seen[n] += 1
            if not m[3]:
                stack.append(n)
        elif not stack or stack.pop() != n:
            problems.append(f"tag {n} is not nested")
    problems += [f"tag {n} is not closed" for n in stack]
    problems += [f"tag {n} is {'missing' if not seen[n] else 'repeated'}" for n in range(1, len(tags) + 1) if seen[n] != 1]
    return problems


def untag(reply: str, tags: list[tuple[str, str]]) -> str:
    """The reply with its tags turned back into marks; unknown tags are dropped."""
    def mark(m: re.Match) -> str:
        n = int(m[2] or m[3])
        return "" if not 1 <= n <= len(tags) else tags[n - 1][1] if m[1] else tags[n - 1][0]

    return _TAGGED.sub(mark, reply)


# --- layout


def adornment(title: str, char: str) -> str:
    """An underline as wide as the title."""
    return char * max(3, X.display_width(title))


def grid_table(rows: list[list[str]], header: bool = True) -> str:
    """A grid table drawn at display widths; short rows are filled up."""
    if not rows:
        return ""
    columns = max(map(len, rows))
    cells = [[*(r[k] if k < len(r) else "" for k in range(columns))] for r in rows]
    widths = [max(X.display_width(r[k]) for r in cells) for k in range(columns)]
    line = lambda c: "+" + "+".join(c * (w + 2) for w in widths) + "+"
    out = [line("-")]
    for k, r in enumerate(cells):
        out.append("|" + "|".join(f" {v}{' ' * (w - X.display_width(v))} " for v, w in zip(r, widths)) + "|")
        out.append(line("=" if header and k == 0 and len(cells) > 1 else "-"))
    return "\n".join(out)


def read_grid(table: str) -> list[list[str]]:
    """Cells of a grid table without spans."""
    return [[c.strip() for c in line.strip("|").split("|")] for line in table.split("\n") if line.startswith("|")]


def anonymous_duplicates(names: list[tuple[str, str]]) -> list[int]:
    """Positions of embedded links whose name was used before for another target: those must become anonymous."""
    seen: dict[str, str] = {}
    out = []
    for k, (name, target) in enumerate(names):
        key = " ".join(name.split()).lower()
        if seen.setdefault(key, target) != target:
            out.append(k)
    return out


def lost_targets(source: str, output: str) -> list[str]:
    """Names that the output refers to and the source defines, but the output no longer does."""
    return sorted(set(X.rst_named_references(output)) & X.rst_defined_names(source) - X.rst_defined_names(output))
