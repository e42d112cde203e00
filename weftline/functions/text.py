"""Scalar text functions in Python, for semantics that need a scanner. Column versions stand in columns.py, vectorised ones in udfs.py."""

from __future__ import annotations

import json
import re
from collections import Counter

import xxhash

# Abbreviations that end no sentence.
ABBREVIATIONS = "e.g. i.e. etc. vs. dr. mr. mrs. ms. prof. inc. ltd. jr. sr. st. ave. dept. est. approx. fig. vol. no. a.k.a. cf. al.".split()
# Capitalised words that open sentences and are no surnames.
SENTENCE_OPENERS = frozenset("The This That These Those There Here It Its In On At An As If When We You They He She For But And So To However Then Now Each All Some No Note See Also Otherwise Since Because After Before With Without Using Our Your Their What Why How".split())
# The alert markers of source texts.
ALERTS = ("[!NOTE]", "[!TIP]", "[!IMPORTANT]", "[!WARNING]", "[!CAUTION]")
# Polite sentence endings that are off the formal register.
POLITE_ENDINGS = ("세요", "어요", "아요", "해요", "예요", "에요", "네요", "지요", "죠")
# Code point ranges of double display width.
WIDE = ((0x1100, 0x115F), (0x2E80, 0x303E), (0x3041, 0x33FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA000, 0xA4CF), (0xAC00, 0xD7A3), (0xF900, 0xFAFF), (0xFE30, 0xFE4F), (0xFF00, 0xFF60), (0xFFE0, 0xFFE6), (0x20000, 0x2FFFD), (0x30000, 0x3FFFD))


# --- hashing and identity


def content_hash(text: str) -> int:
    """XXH64 with seed 0 of the UTF-8 bytes, as an unsigned integer."""
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


def context_hash(before: int | None, after: int | None) -> int:
    """XXH64 of the little-endian hashes of both neighbours; 0 stands for a missing one."""
    return xxhash.xxh64_intdigest(int(before or 0).to_bytes(8, "little") + int(after or 0).to_bytes(8, "little"))


_POSITION = re.compile(r"section:(\d+)/block:(\d+)/seg:(\d+)")


def position(segment_id: str) -> tuple[int, int, int] | None:
    m = _POSITION.fullmatch(segment_id)
    return (int(m[1]), int(m[2]), int(m[3])) if m else None


def flat_index(section: int, block: int, seg: int) -> int:
    return section * 1_000_000 + block * 1000 + seg


def canonical_json(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


# --- normalisation


def normalize_inline(raw: str) -> str:
    """One line: continuation lines lose quote marks and indentation, line breaks become one space."""
    first, *rest = raw.splitlines() or [""]
    parts = [first.rstrip(), *(re.sub(r"^[>\s]+", "", line).rstrip() for line in rest)]
    return " ".join(p for i, p in enumerate(parts) if p)


def normalize_whole(text: str) -> str:
    """Without surrounding white space and emphasis marks and trailing colons and full stops, in lower case."""
    before = None
    text = text.strip()
    while before != text:
        before = text
        text = re.sub(r"^[*_\s]+|[*_\s]+$", "", text).rstrip(":.：")
    return text.lower()


def shorten(text: str, limit: int = 300) -> str:
    """White space collapsed; cut at `limit` characters with an ellipsis."""
    flat = " ".join(text.split())
    return flat if len(flat) <= limit else flat[:limit] + "…"


def snippet(text: str, term: str, size: int) -> str:
    """An excerpt of `size` characters around the first use of term."""
    at = max(0, text.lower().find(term.lower()))
    start = max(0, at - max(0, size - len(term)) // 2)
    cut = text[start : start + size]
    return ("…" if start else "") + cut + ("…" if start + size < len(text) else "")


def heading_slug(text: str) -> str | None:
    """Lower-case words of letters and digits joined by hyphens; None if there are none."""
    return "-".join(re.findall(r"[a-z0-9]+", text.lower())) or None


def display_width(text: str) -> int:
    """Columns on a terminal: wide characters take two."""
    return sum(2 if ord(c) >= 0x1100 and any(a <= ord(c) <= b for a, b in WIDE) else 1 for c in text)


def split_at_space(text: str, width: int, safe=lambda at: True) -> int | None:
    """The safe space nearest to `width` columns with a letter or digit after it."""
    spaces = [m.start() for m in re.finditer(" ", text) if safe(m.start()) and any(c.isalnum() for c in text[m.end() :])]
    return min(spaces, key=lambda at: abs(display_width(text[:at]) - width), default=None)


# --- sentences

_RUN = re.compile(r"`+")
_STOP = re.compile(r"[.!?]")


def _literal_spans(text: str) -> list[tuple[int, int]]:
    """Backtick markup in which no sentence ends: opened where a mark may open, closed by a run at least as long."""
    runs = [(m.start(), m.end()) for m in _RUN.finditer(text)]
    longest_after = [0] * (len(runs) + 1)
    for k in range(len(runs) - 1, -1, -1):
        longest_after[k] = max(longest_after[k + 1], runs[k][1] - runs[k][0])
    spans, k = [], 0
    while k < len(runs):
        a, b = runs[k]
        before = text[a - 1] if a else " "
        opens = before.isspace() or not (before.isalnum() or before in ")]}>")
        if opens and longest_after[k + 1] >= b - a:
            j = next(j for j in range(k + 1, len(runs)) if runs[j][1] - runs[j][0] >= b - a)
            spans.append((a, runs[j][1]))
            k = j + 1
        else:
            k += 1
    return spans


def _ends_sentence(text: str, start: int, at: int) -> bool:
    rest = text[at + 1 :]
    follows = rest.lstrip()
    if follows and (len(follows) == len(rest) or not follows[0].isupper()):
        return False
    head = text[max(start, at - 8) : at + 1].lower()
    for short in ABBREVIATIONS:
        if head.endswith(short) and not head[: -len(short)][-1:].isalnum():
            return False
    if text[at] == "." and follows:
        # a middle initial between two names
        word = re.search(r"(?:^|\s)(\S+) ([^\W\d_])\.$", text[start : at + 1])
        name = re.match(r"\s(([^\W\d_])([^\W\d_])[^\W\d_]*)", rest)
        if word and word[2].isupper() and len(word[1]) >= 2 and word[1][0].isupper() and word[1][1:].islower() and word[1].isalpha() and name and name[2].isupper() and name[3].islower() and name[1] not in SENTENCE_OPENERS:
            return False
    return True


def split_sentences(text: str) -> list[str]:
    """Sentences, trimmed: a full stop, question or exclamation mark outside literals ends one before white space and a capital, or at the end."""
    found, start = [], 0
    spans = _literal_spans(text)
    k = 0
    for m in _STOP.finditer(text):
        at = m.start()
        while k < len(spans) and spans[k][1] <= at:
            k += 1
        if (k < len(spans) and spans[k][0] <= at) or at < start:
            continue
        if _ends_sentence(text, start, at):
            found.append(text[start : at + 1].strip())
            start = at + 1
    found.append(text[start:].strip())
    return [s for s in found if s]


def sentence_count(text: str) -> int:
    """Closing marks at the end or before white space and not after a digit; at least 1."""
    return max(1, len(re.findall(r"(?<![0-9])[.?!。](?=\s|$)", text)))


def truncation_issue(source: str, translation: str, least: float) -> str | None:
    """Why a text looks cut: too short for its source, or less than half of its sentences. Sources under 40 characters are not judged."""
    if len(source) < 40:
        return None
    ratio = len(translation) / len(source)
    if ratio < least:
        return f"length ratio {ratio:.2f} < {least:.2f}"
    a, b = sentence_count(source), sentence_count(translation)
    return f"{b} sentences for {a}" if a >= 2 and 2 * b < a else None


def prose_letters(source: str) -> int:
    """Letters outside backticks and link targets."""
    bare = re.sub(r"`[^`]*(?:`|$)", "", source)
    return sum(c.isalpha() for c in re.sub(r"\]\([^)]*(?:\)|$)", "", bare))


def trivial(segment: str) -> bool:
    return len(segment) < 20 or prose_letters(segment) < 12


# --- links and markers


def alert_markers(text: str) -> list[str]:
    return sorted(re.findall(r"\[![^\]]*\]?", text))


def extract_urls(text: str, brackets_end: bool = False) -> list[str]:
    """Absolute addresses, with balanced parentheses and without closing punctuation; brackets_end for markup that writes the link text after a bracket."""
    found = []
    stop = re.compile(r"[\s<>\"`}\]" + (r"\[" if brackets_end else "") + "]")
    at = 0
    while m := re.compile(r"https?://").search(text, at):
        end = stop.search(text, m.start())
        chunk = text[m.start() : end.start() if end else len(text)]
        depth = 0
        for i, c in enumerate(chunk):
            depth += (c == "(") - (c == ")")
            if depth < 0:
                chunk = chunk[:i]
                break
        at = m.start() + max(len(chunk), len("http://"))
        if bare := chunk.rstrip(".,;:\\"):
            found.append(bare)
    return found


def markdown_destinations(text: str) -> list[str]:
    """Targets of inline links and images that are no absolute addresses."""
    found, at = [], 0
    while (at := text.find("](", at)) >= 0:
        at += 2
        depth, end = 0, len(text)
        for i in range(at, len(text)):
            c = text[i]
            if c.isspace() or (c == ")" and depth == 0):
                end = i
                break
            depth += (c == "(") - (c == ")")
        target = text[at:end].lstrip("<").rstrip(">")
        if target and not target.startswith(("http://", "https://")):
            found.append(target)
        at = end
    return found


def code_reference_labels(text: str) -> list[str]:
    """Shortcut and collapsed references whose label is a code span."""
    return re.findall(r"(?<!\])\[(`[^`\n]+`)\](?!\(|\[[^\]])", text)


def definition_labels(text: str) -> set[str]:
    """Labels of reference definitions outside fenced code, in lower case."""
    bare = re.sub(r"^(```+|~~~+).*?^\1", "", text, flags=re.DOTALL | re.MULTILINE)
    return {m.lower() for m in re.findall(r"^ {0,3}\[([^\]\n]+)\]:\s*\S", bare, re.MULTILINE)}


_RST_LITERAL = re.compile(r"``.+?``")


def rst_named_references(text: str) -> list[str]:
    bare = _RST_LITERAL.sub(" ", text)
    quoted = re.findall(r"(?<![`:\w])`([^`<>\n]+?)(?:\s*<[^<>\n]+>)?`_(?![_\w])", bare)
    return [" ".join(q.split()).lower() for q in quoted] + [w.lower() for w in re.findall(r"(?<![`\w-])([A-Za-z][\w.+-]*[A-Za-z0-9]|[A-Za-z])_(?![\w_])", re.sub(r"`[^`]*`_*", " ", bare))]


def rst_anonymous_references(text: str) -> int:
    return len(re.findall(r"(?:`[^`\n]+`|(?<![\w`])[A-Za-z][\w-]*?)__(?![\w_])", _RST_LITERAL.sub(" ", text)))


def rst_embedded_links(text: str) -> list[tuple[str, str]]:
    return [(a.strip(), b) for a, b in re.findall(r"`([^`<>\n]+?)\s*<([^<>\n]+)>`_", _RST_LITERAL.sub(" ", text))]


def rst_defined_names(text: str) -> set[str]:
    """Explicit targets, titles and embedded links, in lower case."""
    targets = re.findall(r"^\.\. _`?([^`:\n]+)`?:", text, re.MULTILINE)
    titles = re.findall(r"^(\S[^\n]*)\n([=\-~^\"'#*+.:`_]{3,})[ \t]*$", text, re.MULTILINE)
    return {" ".join(n.split()).lower() for n in [*targets, *(t for t, _ in titles), *(a for a, _ in rst_embedded_links(text))]}


def bikeshed_tokens(text: str) -> list[str]:
    bare = re.sub(r"`[^`]*`", " ", text)
    return re.findall(r"\[\[[^\[\]\n]+\]\]|(?<!\w)\|[^|\s][^|\n]*\|(?!\w)", bare)


def math_spans(text: str) -> list[tuple[int, int]]:
    """Character ranges of $, $$, \\( \\) and \\[ \\] formulas."""
    return [m.span() for m in re.finditer(r"\$\$.+?\$\$|(?<![\\\w$])\$(?=\S)[^$\n]+?(?<=\S)\$(?!\d)|\\\(.+?\\\)|\\\[.+?\\\]", text, re.DOTALL)]


def preserved_tokens(text: str) -> list[str]:
    """What a translation of R Markdown must keep: formulas, references, citations and inline code of a language."""
    return [text[a:b] for a, b in math_spans(text)] + re.findall(r"\\@ref\([^)]*\)|(?<![\w@])\[?-?@[A-Za-z][\w:.#$%&+?<>~/-]*\w|`r [^`]+`", text)


# --- register


def off_register_endings(text: str) -> list[str]:
    """Sentence endings before a full stop that leave the formal register, each with at most six syllables."""
    found = []
    for piece in text.split(".")[: text.count(".") + 1]:
        m = re.search("[가-힣]+$", piece)
        if not m:
            continue
        tail = m[0]
        off = any(tail.endswith(p) for p in POLITE_ENDINGS)
        if tail.endswith("다"):
            formal = tail.endswith(("니다", "읍시다"))
            if tail.endswith("시다") and len(tail) > 2:
                formal = formal or (ord(tail[-3]) - 0xAC00) % 28 == 17
            off = off or not formal
        if off:
            found.append(f"…{tail[-6:]}.")
    return found


# --- multisets


def multiset_difference(a: list[str], b: list[str]) -> list[str]:
    """a without b, with multiplicity, in the order of a."""
    left = Counter(b)
    out = []
    for x in a:
        if left[x]:
            left[x] -= 1
        else:
            out.append(x)
    return out


def is_multiset_subset(required: list[str], available: list[str]) -> bool:
    return not Counter(required) - Counter(available)


def rotate_drafts(drafts: list, key: str) -> list:
    """Drafts in an order set by a hash of key: rotated, and reversed when the quotient is even."""
    if not drafts:
        return []
    h = content_hash(key)
    k = h % len(drafts)
    out = drafts[k:] + drafts[:k]
    return out[::-1] if (h // len(drafts)) % 2 == 0 else out


# --- diffs


def patch_targets(patch: str) -> list[str]:
    """Paths that a unified diff touches, in order, once each."""
    found = [p for p in re.findall(r"^\+\+\+ (?:b/)?([^\t\n]+)", patch, re.MULTILINE) if p != "/dev/null"]
    found += [p for p in re.findall(r"^--- (?:a/)?([^\t\n]+)\n\+\+\+ /dev/null", patch, re.MULTILINE)]
    return list(dict.fromkeys(found))
