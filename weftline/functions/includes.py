"""Lines of a source carried to its translation, include directives that name lines, and reference links that follow their labels."""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass


@dataclass(frozen=True)
class LineMap:
    """Lines, from 0, that the blocks of a source and of its translation cover, pair by pair."""

    pairs: tuple[tuple[tuple[int, int], tuple[int, int]], ...]

    @staticmethod
    def between(source: str, ours: list[tuple[str, int, int]], translated: str, theirs: list[tuple[str, int, int]]) -> LineMap | None:
        """The map of two lists of blocks (kind, start, end); None if they do not go together one by one."""
        if [k for k, *_ in ours] != [k for k, *_ in theirs]:
            return None
        extents = [[(text.count("\n", 0, a), text.count("\n", 0, max(a, b - 1))) for _, a, b in blocks] for text, blocks in ((source, ours), (translated, theirs))]
        return LineMap(tuple(zip(*extents)))

    def line(self, n: int) -> int:
        """The translated line of line n: inside a block at the same distance from its begin, but no further than its end; between blocks at the same distance from the next one, but not inside the one before; after the last one at the same distance from it."""
        k = bisect.bisect_right([a for (a, _), _ in self.pairs], n) - 1
        if k >= 0 and n <= self.pairs[k][0][1]:
            (a, _), (c, d) = self.pairs[k]
            return min(c + n - a, d)
        if k + 1 < len(self.pairs):
            (a, _), (c, _) = self.pairs[k + 1]
            mapped = max(0, c - (a - n))
            return min(max(mapped, self.pairs[k][1][1] + 1), c) if k >= 0 else mapped
        if not self.pairs:
            return n
        (_, b), (_, d) = self.pairs[-1]
        return d + n - b


_INCLUDE = re.compile(r"^(?P<i>[ \t]*)\.\. (?:literal)?include::[ \t]*(?P<t>\S+)[ \t]*\n(?P<o>(?:(?P=i)[ \t]+:[\w-]+:[^\n]*(?:\n|\Z))*)", re.MULTILINE)
_OPTION = re.compile(r"(:(?:start|end)-line:[ \t]*)(-?\d+)")


def include_targets(text: str) -> list[tuple[str, int | None, int | None]]:
    """(target, start line, end line) of the include directives; lines that are not named are None."""
    found = []
    for m in _INCLUDE.finditer(text):
        options = {k: int(v) for k, v in re.findall(r":(start|end)-line:[ \t]*(-?\d+)", m["o"])}
        found.append((m["t"], options.get("start"), options.get("end")))
    return found


def rewrite_lines(text: str, maps: dict[str, LineMap]) -> str:
    """The text with the line options of its includes carried to the translations of their targets; targets without a map, and lines counted from the end, stay as they are."""

    def one(m: re.Match) -> str:
        known = maps.get(m["t"])
        if known is None:
            return m[0]
        options = _OPTION.sub(lambda o: o[1] + (o[2] if int(o[2]) < 0 else str(known.line(int(o[2])))), m["o"])
        return m[0][: m.start("o") - m.start()] + options + m[0][m.end("o") - m.start() :]

    return _INCLUDE.sub(one, text)


_REFERENCE = re.compile(r"(?<![\\!\]])\[([^\[\]\n]+)\](?:\[([^\[\]\n]*)\])?(?![(:\[])")


def definition_labels(text: str) -> set[str]:
    """Labels of the link definitions, in one case and spacing."""
    return {" ".join(m.split()).casefold() for m in re.findall(r"^ {0,3}\[([^\[\]\n]+)\]:[ \t]*\S", text, re.MULTILINE)}


def full_references(source: str, rendering: str, labels: set[str]) -> str:
    """The rendering with its references in full form, [text][label]: those whose text is a label stay; the others are paired with the source's in their order. If their numbers differ nothing is changed."""
    key = lambda t: " ".join(t.split()).casefold()
    ours = [m[2] or m[1] for m in _REFERENCE.finditer(source) if key(m[2] or m[1]) in labels]
    theirs = list(_REFERENCE.finditer(rendering))
    if len(ours) != len(theirs) or not ours:
        return rendering
    left = list(ours)
    for m in theirs:
        match = next((o for o in left if key(o) == key(m[2] or m[1])), None)
        if match:
            left.remove(match)
    out, at = [], 0
    for m in theirs:
        out.append(rendering[at : m.start()])
        known = key(m[2] or m[1]) in labels
        out.append(m[0] if known else f"[{m[1]}][{left.pop(0)}]")
        at = m.end()
    return "".join(out) + rendering[at:]


_TITLE_REFERENCE = re.compile(r"(?<![`:\w])`([^`<>\n]+?)`(_(?![_\w]))")


def follow_titles(text: str, titles: dict[str, str]) -> str:
    """reStructuredText with its references to section titles, `Title`_, renamed as the titles are; titles in any case and spacing."""
    if not titles or "`_" not in text:
        return text
    known = {" ".join(k.split()).casefold(): v for k, v in titles.items()}
    return _TITLE_REFERENCE.sub(lambda m: f"`{known.get(' '.join(m[1].split()).casefold(), m[1])}`{m[2]}", text)
