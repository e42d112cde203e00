"""Checks and repairs that depend on the markup: pairs that cannot close, references, roles, structure tokens; and inline tags of XML."""

from __future__ import annotations

import re
from collections import Counter

# --- code written otherwise


def shed_edges(content: str) -> str:
    """Code without the sentence punctuation at its end and parentheses at its edges that have no partner."""
    while True:
        extra = content.count("(") - content.count(")")
        if content[-1:] and content[-1:] in ".,;:!?" or (content.endswith(")") and extra < 0):
            content = content[:-1]
        elif content.startswith("(") and extra > 0:
            content = content[1:]
        else:
            return content


def stands_for(written: str, content: str) -> bool:
    """Whether a rendering may write `written` for the code `content`: without the plural of a plain word, without the call's parentheses, without edges that are no code."""
    stem = content[:-1]
    plural = content.endswith("s") and stem.isascii() and stem.isalpha() and not stem.endswith("s") and (len(stem) >= 3 or len(stem) == 2 and stem.isupper())
    return (plural and written == stem) or (content.endswith("()") and written == content[:-2]) or written == shed_edges(content)


def written_as_text(source: str, content: str) -> bool:
    """Whether the source writes the content as words of its own."""
    return bool(content) and re.search(rf"(?<!\w){re.escape(content)}(?!\w)", source) is not None


def unmatched_code(ours: list[str], theirs: list[str]) -> tuple[list[str], list[str]]:
    """(code of the source that nothing stands for, code of the rendering left over): equal ones first, then those that may stand for each other."""
    spare = Counter(theirs)
    left = []
    for c in ours:
        if spare[c]:
            spare[c] -= 1
        else:
            left.append(c)
    missing = []
    for c in left:
        match = next((w for w in spare if spare[w] and stands_for(w, c)), None)
        if match is None:
            missing.append(c)
        else:
            spare[match] -= 1
    return missing, sorted(spare.elements())


# --- AsciiDoc: constrained marks close only where no word touches them

CONSTRAINED = {m: re.compile(rf"(?<![\w\"'{re.escape(m)}]){re.escape(m)}(?![\s{re.escape(m)}])([^{re.escape(m)}\n]*?[^\s{re.escape(m)}]){re.escape(m)}(?!{re.escape(m)})(?P<after>.?)", re.DOTALL) for m in "`*_#"}
_QUOTED = re.compile(r"([\"'])`(.+?)`\1(?P<after>.?)", re.DOTALL)


def unclosable_pairs(text: str) -> list[str]:
    """Pairs of single marks that open but are held open by the word or quote after them, with that character. Doubled marks pair anywhere."""
    found = []
    for pattern in CONSTRAINED.values():
        for m in pattern.finditer(_QUOTED.sub(lambda q: " " * len(q[0]), text)):
            if m["after"] and (m["after"].isalnum() or m["after"] in "_\"'"):
                found.append(m[0])
    return found


def unclosable_quotes(text: str) -> list[str]:
    """Curved quotes, "`so`" and '`so`', that a word after them keeps open."""
    return [m[0] for m in _QUOTED.finditer(text) if m["after"] and (m["after"].isalnum() or m["after"] == "_")]


# --- reStructuredText

_BLOCKS_END = r"[\w(\[{<]"


def _rst_pairs(text: str) -> list[tuple[str, bool]]:
    """(pair as written, whether it reads as one) of inline literals, interpreted text, strong and plain emphasis."""
    found = []
    hidden = text
    for mark in ("``", "`", "**", "*"):
        m_ = re.escape(mark)
        one = re.escape(mark[0])
        pattern = re.compile(rf"(?P<before>\w?)(?<!{one}){m_}(?!{one})(?P<body>\S(?:[^\n]*?\S)?\s?|\S){m_}(?!{one})(?P<suffix>_{{0,2}})(?P<after>.?)" if mark[0] == "`" else rf"(?P<before>\w?)(?<!{one}){m_}(?!{one})(?P<body>[^\s*](?:[^*\n]*[^*\n])?){m_}(?!{one})(?P<suffix>)(?P<after>.?)")
        for m in pattern.finditer(hidden):
            glued = re.search(r":[\w.+-]+:$", text[: m.start("body") - len(mark)]) is not None
            broken = (m["before"] and not glued) or re.match(_BLOCKS_END, m["after"] or " ") is not None or m["body"][-1:].isspace()
            found.append((m[0], not broken))
        hidden = pattern.sub(lambda m: " " * len(m[0]), hidden)
    return found


def rst_broken_pairs(text: str) -> list[str]:
    """Pairs that do not read as markup: a word touches them, or white space stands before their end."""
    return [pair for pair, good in _rst_pairs(text) if not good]


def rst_broken_references(text: str) -> list[str]:
    """Footnote and citation references, [1]_, that a word touches."""
    return [m[0] for m in re.finditer(r"(?P<before>\w?)\[[^\]\n]*\]_(?P<after>.?)", text) if m["before"] or re.match(_BLOCKS_END, m["after"] or " ")]


def rst_reference_runs(text: str) -> int:
    """Runs of backticks that belong to hyperlinks: `name`_, `text <target>`_ and :role:`text` without literals."""
    bare = re.sub(r"``[^`\n]+``", " ", text)
    return 2 * len(re.findall(r"(?<!`)`[^`\n]+`_{1,2}(?!\w)", bare))


def rst_duplicate_roles(text: str) -> list[str]:
    """Roles whose text does not close on its line or is followed by a letter."""
    return re.findall(r":[\w.+-]+:`[^`\n]*(?:$|`(?=[^\W_]))", text, re.MULTILINE)


# --- Verso, LaTeX

_VERSO = re.compile(r"(?P<math>\$\$?`[^`]*`)|(?P<header>\{[A-Za-z][^{}]*\})(?:(?P<code>`[^`]*`)|(?P<label>(?=\[)))?")


def verso_structure(text: str) -> list[str]:
    """Formulas, and roles with what they apply to, sorted: sentences may change places, nothing may get lost."""
    out = []
    for m in _VERSO.finditer(text):
        out.append("math " + m["math"] if m["math"] else f"code {m['header']}{m['code']}" if m["code"] else f"label {m['header']}" if m["label"] is not None else f"role {m['header']}")
    return sorted(out)


def restore_verso(source: str, rendering: str) -> str:
    """The rendering with the source's non-breaking spaces put back into code that is the same but for them."""
    plain = lambda code: code.replace("\\u{a0}", " ").replace("\u00a0", " ")
    kept: dict[tuple[str, str], list[str]] = {}
    for m in _VERSO.finditer(source):
        if m["code"] and "\u00a0" in m["code"]:
            kept.setdefault((m["header"], plain(m["code"])), []).append(m[0])

    def put(m: re.Match) -> str:
        waiting = kept.get((m["header"], plain(m["code"]))) if m["code"] else None
        return waiting.pop(0) if waiting else m[0]

    return _VERSO.sub(put, rendering)


_ARGUMENT = r"\s*\{(?:[^{}]|\{[^{}]*\})*\}"
_KEYS = re.compile(rf"\\(?:(?:Cref|cref|cite|citeauthor|citep|citet|eqref|include|includegraphics|input|label|symlabel|pageref|ref|url|href|index|indexdef|indexfoot)\*?(?:\s*\[[^\]]*\])*{_ARGUMENT}|indexsee(?:{_ARGUMENT}){{2}})")


def without_reference_keys(text: str) -> str:
    """LaTeX text without the keys of references and the targets of links; a link's label stays."""
    return _KEYS.sub(" ", text)


# --- all checks of one markup


def markup_issues(source: str, rendering: str, markup: str) -> list[str]:
    """What the rendering breaks of the markup that the source has in order."""
    found: list[str] = []
    if markup == "asciidoc":
        for name, check in (("pair", unclosable_pairs), ("quote", unclosable_quotes)):
            bad = check(rendering)
            if len(bad) > len(check(source)):
                found += [f"{name} {b} cannot close" for b in bad]
    elif markup in ("rst", "pep"):
        for name, check in (("pair", rst_broken_pairs), ("reference", rst_broken_references), ("role", rst_duplicate_roles)):
            bad = check(rendering)
            if len(bad) > len(check(source)):
                found += [f"{name} {b} is not read as markup" for b in bad]
        if rst_reference_runs(rendering) < rst_reference_runs(source):
            found.append("references are missing")
        lost = sum(good for _, good in _rst_pairs(source)) - sum(good for _, good in _rst_pairs(rendering))
        if lost > 0:
            found.append(f"{lost} inline pairs are missing")
    elif markup == "verso":
        a, b = Counter(verso_structure(source)), Counter(verso_structure(rendering))
        found += [f"structure {t} differs" for t in sorted((a - b) + (b - a))]
    return found


# --- inline tags of XML

_ELEMENT = re.compile(r"<!--.*?-->|<(?P<close>/)?(?P<name>[A-Za-z][\w:.-]*)(?:[^<>\"']|\"[^\"]*\"|'[^']*')*?(?P<self>/)?>", re.DOTALL)


def xml_tagify(source: str, whole: frozenset[str] = frozenset("code kbd samp tt math m c svg img br".split())) -> tuple[str, list[tuple[str, str]]]:
    """Text with numbered tags for its elements, and the (opening, closing) markup of each; elements of `whole`, empty ones, comments and marks without a partner stand alone."""
    marks = list(_ELEMENT.finditer(source))
    partner: dict[int, int] = {}
    stack: list[int] = []
    for k, m in enumerate(marks):
        if not m["name"] or m["self"]:
            continue
        if not m["close"]:
            stack.append(k)
        else:
            at = next((i for i in range(len(stack) - 1, -1, -1) if marks[stack[i]]["name"] == m["name"]), None)
            if at is not None:
                partner[stack[at]] = k
                del stack[at:]
    closing = {b: a for a, b in partner.items()}
    tags: list[tuple[str, str]] = []
    number: dict[int, int] = {}
    out, at = [], 0
    for k, m in enumerate(marks):
        if m.start() < at:
            continue
        out.append(source[at : m.start()])
        at = m.end()
        if k in partner and m["name"].split(":")[-1] in whole:
            at = marks[partner[k]].end()
            tags.append((source[m.start() : at], ""))
            out.append(f"<x{len(tags)}/>")
        elif k in partner:
            tags.append((m[0], marks[partner[k]][0]))
            number[k] = len(tags)
            out.append(f"<g{len(tags)}>")
        elif k in closing and closing[k] in number:
            out.append(f"</g{number[closing[k]]}>")
        else:
            tags.append((m[0], ""))
            out.append(f"<x{len(tags)}/>")
    return "".join(out) + source[at:], tags


def xml_prose(source: str, hidden: frozenset[str] = frozenset("script style math svg".split())) -> str:
    """The visible text of a fragment, entities decoded and white space in one."""
    import html

    bare = source
    for name in sorted(hidden):
        bare = re.sub(rf"<{name}\b.*?</{name}\s*>", " ", bare, flags=re.DOTALL | re.IGNORECASE)
    return " ".join(html.unescape(_ELEMENT.sub("", bare)).split())


# --- an inline audit


def audit(markup: str, source: str, rendering: str, issues, repair) -> tuple[str, str, list[str]]:
    """(Sound, Repaired or Unrepairable; the rendering after repair; the defects) of a stored rendering: a repair counts only if nothing is left to find."""
    defects = issues(source, rendering, markup)
    if not defects:
        return "Sound", rendering, []
    mended = repair(markup, source, rendering)
    if mended != rendering and not issues(source, mended, markup):
        return "Repaired", mended, defects
    return "Unrepairable", rendering, defects
