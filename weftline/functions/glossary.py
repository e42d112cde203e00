"""Finding glossary terms in prose, and the prose itself: what is code, an address, a tag or part of a name doesn't count."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from weftline.functions.text import normalize_whole

#: Entries at most of a glossary that is sent to every task; it is a dimension, not data.
MOST_TERMS = 200_000

_VERBATIM = re.compile(
    r"(?P<t>`+)(?!`).*?(?<!`)(?P=t)(?!`)"
    r"|\]\([^)]*\)"
    r"|(?<!\w)(?:https?://|ftp://|mailto:|link:|xref:|image:|video:|audio:)[^\s\[]*"
    r"|(?<!<)</?[A-Za-z][A-Za-z0-9-]*(?:\s[^<>\n]*=[^<>\n]*|\s*)/?>"
    r"|(?<=\])\[[^\[\]\n]*\]",
    re.DOTALL,
)
_TOKEN_BOUND = re.compile(r"[\s()\[\]<>\"'`,;{}$\\]")


def verbatim_spans(text: str) -> list[tuple[int, int]]:
    """Ranges a reader sees as written: code spans, targets, tags and reference labels."""
    return [m.span() for m in _VERBATIM.finditer(text)]


def in_a_name(text: str, start: int, end: int) -> bool:
    """Whether the word is part of a longer name: a handle, command, flag, file, path or label."""
    before, after = text[max(0, start - 2) : start], text[end : end + 2]
    ascii_alnum = lambda c: c.isascii() and c.isalnum()
    if before[-1:] and before[-1] in "@#\\" or before == "--":
        return True
    if len(after) == 2 and ((after[0] in "=.:" and ascii_alnum(after[1])) or after == "::"):
        return True
    if len(before) == 2 and ((before[1] in ".:" and ascii_alnum(before[0])) or before == "::"):
        return True
    if (before[-1:] or " ") not in "/-" and (after[:1] or " ") not in "/-":
        return False
    left = max((m.end() for m in _TOKEN_BOUND.finditer(text, 0, start)), default=0)
    right = m.start() if (m := _TOKEN_BOUND.search(text, end)) else len(text)
    token = text[left:start].lstrip("*_.:!?") + text[start:end] + text[end:right].rstrip("*_.:!?")
    return token.startswith("/") or bool(re.search(r"[_#]|[A-Za-z0-9]:[A-Za-z0-9]|\.[A-Za-z0-9]", token))


@dataclass
class Glossary:
    """Terms with their translations, the phrases in which a term is an ordinary word, and whole-segment entries."""

    terms: dict[str, str]
    excepts: dict[str, list[str]] = field(default_factory=dict)
    whole: dict[str, tuple[str, str]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if len(self.terms) + len(self.whole) > MOST_TERMS:
            raise ValueError(f"a glossary of more than {MOST_TERMS} entries must be joined, not sent")
        # longest first: a term inside a longer one that stands there is no use of its own
        self._order = sorted(self.terms, key=lambda t: (-len(t), t))
        self._lower = {t: t.lower() for t in self._order}

    def uses(self, text: str) -> dict[str, str]:
        """Terms that the text uses as prose."""
        low = text.lower()
        hidden = verbatim_spans(low)
        claimed: list[tuple[int, int]] = []
        found: dict[str, str] = {}
        for term in self._order:
            key = self._lower[term]
            if not key or key not in low:
                continue
            ordinary = [m.span() for p in self.excepts.get(term, ()) if p for m in re.finditer(f"(?={re.escape(p.lower())})", low)]
            widths = [len(p) for p in self.excepts.get(term, ()) if p for _ in re.finditer(f"(?={re.escape(p.lower())})", low)]
            spans = []
            for m in re.finditer(f"(?={re.escape(key)})", low):
                a, b = m.start(), m.start() + len(key)
                word = lambda c: c.isalnum() or c == "_"
                if (a and word(low[a - 1])) or (b < len(low) and word(low[b])) or in_a_name(low, a, b):
                    continue
                if any(s < b and a < e for s, e in hidden) or any(s <= a and b <= e for s, e in claimed):
                    continue
                if any(s <= a and b <= s + w for (s, _), w in zip(ordinary, widths)):
                    continue
                spans.append((a, b))
            if spans:
                claimed += spans
                found[term] = self.terms[term]
        return found

    def find(self, text: str) -> dict[str, str]:
        """Used terms, and the whole-segment entry under its own spelling."""
        found = self.uses(text)
        if entry := self.whole.get(normalize_whole(text)):
            found[entry[0]] = entry[1]
        return found

    def unmet(self, source: str, translation: str) -> list[tuple[str, str]]:
        """Used terms whose rendering the translation lacks, sorted; a whole-segment entry must equal it."""
        low = translation.lower()
        missing = {t: r for t, r in self.uses(source).items() if r.lower() not in low}
        if entry := self.whole.get(normalize_whole(source)):
            if normalize_whole(translation) != normalize_whole(entry[1]):
                missing[entry[0]] = entry[1]
        return sorted(missing.items())


# Words that neither begin nor end a term.
STOPWORDS = frozenset("a about above after again against all also am an and any are as at be because been before being below between both but by can could did do does doing down during each either else etc even ever every few for from further had has have having he her here hers him his how however i if in into is it its itself just let may me might more most much must my neither no nor not now of off on once one only or other our ours out over own per rather same shall she should since so some such than that the their theirs them then there these they this those though through thus to too under until up upon us very via was we were what when where whether which while who whom whose why will with within without would yet you your yours it's don't doesn't isn't can't won't we're you're that's there's let's i'm we'll you'll e.g i.e".split())

_NOT_PROSE = re.compile(
    r"(?P<t>`+|\$+).*?(?P=t)|<[^>\n]{0,200}>|\]\([^)]*(?:\)|$)|https?://[^\s)>\]]*|(?<![\w-]):[A-Za-z0-9:+._-]{2,}:(?=`)|\\[A-Za-z]*",
    re.DOTALL,
)
_WORDS = re.compile(r"[^\W_](?:[^\W_]|['’-])*|[*_~\s]+|.", re.DOTALL)


def prose_chunks(source: str) -> list[list[str]]:
    """Runs of words of at least two letters without digits; anything else but white space and emphasis marks ends a run."""
    chunks: list[list[str]] = [[]]
    for m in _WORDS.finditer(_NOT_PROSE.sub("\0", source)):
        w = m.group()
        if w[0].isalnum():
            w = w.strip("-'’").replace("’", "'")
            if len(w) >= 2 and not any(c in "0123456789" for c in w):
                chunks[-1].append(w)
            elif w:
                chunks.append([])
        elif not (w[0].isspace() or w[0] in "*_~"):
            chunks.append([])
    return [c for c in chunks if c]


def ngrams(chunk: list[str], longest: int = 3) -> list[tuple[str, str]]:
    """(key, spelling) of the n-grams of a run without stopwords at either end; single words have at least three letters."""
    low = [w.lower() for w in chunk]
    return [
        (" ".join(low[i : i + n]), " ".join(chunk[i : i + n]))
        for n in range(1, longest + 1)
        for i in range(len(chunk) - n + 1)
        if low[i] not in STOPWORDS and low[i + n - 1] not in STOPWORDS and (n > 1 or len(low[i]) >= 3)
    ]


def singulars(key: str) -> list[str]:
    """Singular forms a plural key may have, in order of preference."""
    head, _, last = key.rpartition(" ")
    if len(last) < 4 or last.endswith(("ss", "us", "is")):
        return []
    stems = [last[:-3] + "y"] if last.endswith("ies") else []
    stems += [last[:-2]] if last.endswith("es") else []
    stems += [last[:-1]] if last.endswith("s") else []
    return [f"{head} {s}".strip() for s in stems]
