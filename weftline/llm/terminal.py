"""Terminal-context model: does a text still have its end?

Positives are made by cutting intact values; a hashed logistic regression over the closing
characters, punctuation, open markup, length and the source's unmatched rest is fitted on a
bounded sample on the driver and then scores every row on the executors.
"""

from __future__ import annotations

import functools
import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
from pyspark.sql import Column

#: Size of the hashed feature space, and of a row's feature list.
DIMENSIONS, WIDTH = 1 << 18, 32
#: Signs of omission that may stand for a lost rest (fixed values).
OMISSIONS = ("[...]", "[…]", "(...)", "(…)", "...", "…", "�")

_OMITTING = frozenset(sign[-1] for sign in OMISSIONS)
_DIGITS = re.compile(r"\d+")
_ANCHOR = re.compile(r"`[^`\n]+`|https?://\S+|\d+")
_SENTENCE = re.compile(r"(?<=[.!?:。])\s+|(?<=。)(?=\S)")


def sentences(text: str) -> list[str]:
    """Coarse sentences: split after closing punctuation followed by white space, and after an ideographic full stop."""
    text = text.strip()
    # most texts are one sentence: nothing closes before the last place
    if not any(c in text[:-1] for c in ".!?:。"):
        return [text] if text else []
    return [s for s in _SENTENCE.split(text) if s]


def strip_omission(text: str) -> tuple[str, str]:
    """(text without a trailing sign of omission, that sign)."""
    bare = text.rstrip()
    if bare[-1:] not in _OMITTING or (bare.endswith(".") and not bare.endswith("..")):
        return bare, ""
    for sign in OMISSIONS:
        if bare.endswith(sign):
            return bare[: -len(sign)].rstrip(), sign
    return bare, ""


def _closing(text: str) -> str:
    if not text:
        return "none"
    c = text[-1]
    if not c.isalnum():
        return c
    return "hangul" if "가" <= c <= "힣" else "kana" if "぀" <= c <= "ヿ" else "digit" if c.isdigit() else "latin" if c < "ɐ" else "letter"


def _anchors(text: str) -> set[str]:
    found = _ANCHOR.findall(text)
    return {a.strip("`").rstrip("()") for a in found} if found else set()


def kind_of(source: str | None, sign: str) -> str:
    """Contexts are learned apart for texts without a source, headings, sources that trail off themselves, and other texts."""
    if source is None:
        return "m"
    src, src_sign = strip_omission(source)
    return "o" if src_sign and sign else "h" if src and src[-1].isalnum() else "t"


@functools.lru_cache(1 << 14)
def _read(source: str) -> tuple[str, str, str, list[str], frozenset[str]]:
    """(text, sign of omission, closing, sentences, anchors) of a source, which several examples share."""
    src = source.rstrip()
    bare, sign = strip_omission(src)
    return src, sign, _closing(bare), sentences(src), frozenset(_anchors(src))


@functools.lru_cache(1 << 14)
def _halves(source: str, n: int) -> tuple[frozenset[str], frozenset[str]]:
    """Anchors of the first n sentences of a source, and of the rest."""
    parts = _read(source)[3]
    return frozenset(_anchors(" ".join(parts[:n]))), frozenset(_anchors(" ".join(parts[n:])))


def features(source: str | None, text: str, limits: frozenset[int]) -> list[int]:
    """Hashed features of one text; source is what it renders, or None."""
    bare, sign = strip_omission(text)
    kind = kind_of(source, sign)
    tokens = bare[-160:].split()
    masked = [t if t.isalpha() else _DIGITS.sub("0", t) for t in tokens[-3:]]
    last = masked[-1] if masked else ""
    src, src_sign, src_close, theirs, known = _read(source) if source is not None else ("", "", "-", [], frozenset())
    close = _closing(bare)
    ticks = bare.count("`") % 2
    out = [f"{kind}close {close} {src_close if not src_close.isalpha() else 'word'}", f"{kind}omit {sign} {src_sign}", f"{kind}last {last}", f"{kind}last2 {' '.join(masked[-2:])}", f"{kind}last3 {' '.join(masked)}"]
    out += [f"{kind}suffix{n} {last[-n:]}" for n in (1, 2, 3, 4)]
    out += [f"{kind}ticks {ticks}", f"{kind}quotes {bare.count(chr(34)) % 2}", f"{kind}open {min(2, max(0, bare.count('[') - bare.count(']')))} {min(2, max(0, bare.count('(') - bare.count(')')))} {min(2, max(0, bare.count('{') - bare.count('}')))}", f"{kind}tag {int(bare.rfind('<') > bare.rfind('>'))}"]
    out += [f"{kind}limit {int(len(text) in limits)} {close.isalpha()}", f"{kind}blank {int(text != text.rstrip())} {close}"]
    if source is not None:
        ours = sentences(bare)
        lack = len(theirs) - len(ours)
        own = _anchors(" ".join(tokens[:-1]) if len(ours) < 2 else bare[: max(0, len(bare) - len(tokens[-1]) if tokens else 0)])
        first, rest = _halves(source, len(ours))
        alien = "alien" if own - known else "known"
        missing = len(first - own) / len(first) if first else -1
        front = "none" if missing < 0 else "full" if missing == 0 else "most" if missing < 0.5 else "few"
        tail = "none" if not rest else "lost" if not rest & own else "kept" if rest <= own else "part"
        ratio = len(bare) / max(1, len(src))
        out += [f"lack {max(-2, min(3, lack))}", f"shape {max(-1, min(3, lack))} {alien} {front} {tail}", f"lackclose {max(-1, min(2, lack))} {close}", f"ratio {min(30, int(ratio * 20))}", f"ratioshape {min(10, int(ratio * 10))} {max(-1, min(2, lack))} {alien}", f"front {front} {alien} {close}", f"words {src_close.isalpha() and f'{min(9, len(src.split()))} {min(9, len(bare.split()))}'}", f"title {src_close.isalpha()} {last}", f"title2 {src_close.isalpha()} {' '.join(masked[-2:])}"]
    return [crc32(f.encode("utf-8", "replace")) % (DIMENSIONS - 1) + 1 for f in out]


def matrix(rows: list[tuple[str | None, str]], limits: frozenset[int]) -> np.ndarray:
    """Feature indices of all rows, padded with the unused index 0."""
    found = np.zeros((len(rows), WIDTH), np.int32)
    for i, (source, text) in enumerate(rows):
        f = features(source, text, limits)
        found[i, : len(f)] = f
    return found


def cut(text: str, rng: random.Random, limits: frozenset[int]) -> str | None:
    """The text cut at a common limit that it exceeds, or anywhere; at times with a sign of omission."""
    bare = text.rstrip()
    if len(bare) < 2:
        return None
    exceeded = sorted(n for n in limits if n < len(bare))
    if exceeded and rng.random() < 0.4:
        return bare[: rng.choice(exceeded)]
    at = rng.randrange(1, len(bare))
    kept, roll = bare[:at], rng.random()
    if roll < 0.04:
        return kept + "…"
    if roll < 0.07:
        return kept.rstrip() + " …"
    if roll < 0.10:
        return kept + "..."
    if roll < 0.13:
        return kept.rstrip() + " [...]"
    return kept + "�" if roll < 0.16 else kept


def cut_after_sentence(text: str, rng: random.Random) -> str | None:
    """The text cut between two of its sentences."""
    found = list(_SENTENCE.finditer(text.strip()))
    if not found:
        return None
    at = rng.choice(found)
    return text.strip()[: at.end() if rng.random() < 0.5 else at.start()]


def common_limits(counts: dict[int, int]) -> frozenset[int]:
    """Lengths at which conspicuously many open-ended texts stop, from the number of such texts of each length.

    At least 8, 4 times the mean of the 10 lengths around, and more than chance gives about that mean at any of
    all lengths (a bound on the Poisson tail), so that a larger table shows the limits of a smaller one but no others.
    """
    found = set()
    for n, count in counts.items():
        mean = max(1.0, sum(counts.get(n + d, 0) for d in range(-5, 6) if d) / 10)
        if count >= 8 and count >= 4 * mean and count - mean - count * math.log(count / mean) + math.log(len(counts)) < math.log(0.05):
            found.add(n)
    return frozenset(found)


def open_ended(text: Column) -> Column:
    """Whether a text ends in a letter or digit, white space aside, as the texts do that limits are counted over."""
    return text.rlike(r"(?sU)[\p{L}\p{N}]\s*$")


class TerminalModel:
    """Weights of the regression; small and of fixed size, so it can be sent to every task."""

    def __init__(self, weights: np.ndarray, limits: frozenset[int]) -> None:
        self.weights, self.limits = weights, limits

    def margin(self, rows: list[tuple[str | None, str]]) -> np.ndarray:
        return self.weights[matrix(rows, self.limits)].sum(1) if rows else np.zeros(0, np.float32)


def _train(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, epochs: int = 5, rate: float = 0.2, batch: int = 384) -> np.ndarray:
    w, squares = np.zeros(DIMENSIONS, np.float32), np.full(DIMENSIONS, 1e-3, np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(order), batch):
            rows = order[i : i + batch]
            at = x[rows]
            p = 1 / (1 + np.exp(-np.clip(w[at].sum(1), -30, 30)))
            g = np.repeat((p - y[rows])[:, None], x.shape[1], 1).ravel()
            flat = at.ravel()
            used, inverse = np.unique(flat, return_inverse=True)
            total = np.bincount(inverse, g).astype(np.float32)
            squares[used] += total * total
            w[used] -= rate * total / np.sqrt(squares[used])
            w[0] = 0
    return w


def _examples(rows: list[tuple[str | None, str]], rng: random.Random, cuts: int, limits: frozenset[int]) -> tuple[list[tuple[str | None, str]], np.ndarray, np.ndarray]:
    """Whole values, some of them again under a foreign source, and cut ones; with their labels and the row each comes from. The first len(rows) examples are the rows themselves."""
    prose = [k for k, (s, _) in enumerate(rows) if s is not None and kind_of(s, "") == "t"]
    kept: list[tuple[str | None, str | None, int]] = [(s, t, k) for k, (s, t) in enumerate(rows)]
    for k in prose[::5]:
        other = rng.choice(prose)
        kept.append((rows[k][0], rows[other][1], other))
    lost: list[tuple[str | None, str | None, int]] = []
    for k, (s, t) in enumerate(rows):
        if s is not None and kind_of(s, "") == "h":
            # shorter than any limit, so seldom cut: fewer positives, and the whole value counts twice
            kept.append((s, t, k))
            if rng.random() < 0.5:
                lost.append((s, cut(t, rng, limits), k))
            continue
        lost += [(s, cut(t, rng, limits), k) for _ in range(cuts if s is not None else 3 * cuts)]
        if s is not None:
            lost.append((s, cut_after_sentence(t, rng), k))
    found = [x for x in lost if x[1] and x[1].strip()]
    every = kept + found
    return [(s, t) for s, t, _ in every], np.r_[np.zeros(len(kept)), np.ones(len(found))].astype(np.float32), np.array([k for *_, k in every])


def _supported(x: np.ndarray, least: int = 4) -> np.ndarray:
    """Blank the features that fewer than `least` examples have: they would only be learned by heart."""
    return np.where(np.bincount(x.ravel(), minlength=DIMENSIONS)[x] >= least, x, 0)


def fit(intact: list[tuple[str | None, str]], seed: int = 11, cuts: int = 2, folds: int = 3, limits: frozenset[int] | None = None) -> TerminalModel:
    """Fit on whole values: each stays as a negative and gives `cuts` cut positives, or three times as many if it has no source.

    Whole values under a foreign source are negatives too: an outdated text is not a cut one. The sample itself
    holds some cut values; they are found by models of the other folds (equal texts share a fold) and leave the
    negatives. An empty sample gives a model that calls nothing cut.
    limits are the common limits of all texts, if the values are only a sample of them; without it they are counted here.
    """
    rng, order = random.Random(seed), np.random.default_rng(seed)
    rows = [(s, t) for s, t in intact if t and t.strip()]
    if not rows:
        return TerminalModel(np.zeros(DIMENSIONS, np.float32), frozenset())
    if limits is None:
        limits = common_limits(Counter(len(t) for t in {t for _, t in rows} if _closing(t.rstrip()).isalpha()))
    fold = np.array([crc32(t.encode("utf-8", "replace")) % folds for _, t in rows])
    examples, y, origin = _examples(rows, rng, cuts, limits)
    x = matrix(examples, limits)
    # headings are too short to be judged by their fellows in a small sample; without a sign of omission they stay
    fixed = np.array([s is not None and kind_of(s, "") == "h" and not strip_omission(t)[1] for s, t in rows])
    whole = np.ones(len(rows), bool)
    for _ in range(2):
        found = whole.copy()
        for k in range(folds):
            part = whole[origin] & (fold[origin] != k)
            if part.any() and (fold == k).any():
                weights = _train(_supported(x[part]), y[part], order)
                found[fold == k] = (weights[x[: len(rows)][fold == k]].sum(1) < 0) | fixed[fold == k]
        whole = found if found.any() else whole
    part = whole[origin]
    return TerminalModel(_train(_supported(x[part]), y[part], order), limits)
