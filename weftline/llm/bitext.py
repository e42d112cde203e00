"""Sentence alignment in bilingual documents.

Numbers, code, addresses, names and cognates that both sides share are anchors. Pairs of sentences that hold an anchor
found nowhere else are chained by a longest increasing subsequence; the gaps between the links of
the chain are aligned by local dynamic programming with one-to-one, merge, split and skip moves,
scored by shared anchors and by a word lexicon. The lexicon is fitted (IBM model 1, both ways) on all
documents: first on sentences that share anchors, then on the links that the lexicon so far gives. What is left on both
sides is paired by score alone, for sentences that moved.
"""

from __future__ import annotations

import bisect
import functools
import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import checkpoint

#: Documents at most that `sample` takes at random, and more that words the random ones lack bring in. No query uses it: lexicons are fitted on all documents.
SAMPLE, MORE = 800, 1200
#: Words of both languages, and pairs of words met in one pair of sentences, up to which a lexicon is broadcast; with more it is fitted and used by joins.
WORDS, LINKS = 200_000, 2_000_000
#: Rounds of model 1 in a fit, and fits.
ROUNDS, FITS = 6, 3
#: Documents a word must be in to be learned.
SEEN = 3
#: Renderings kept of a word, with at least this probability.
RENDERINGS, LEAST = 12, 0.04
#: Cells of a gap's table that are filled at once; a bound on memory, not on what is searched.
CELLS = 1 << 20

_CODE = re.compile(r"`([^`\n]+)`|(https?://[^\s`)]+)")
_NUMBER = re.compile(r"\d+(?:[.,]\d+)*")
_WORD = re.compile(r"[^\W\d_]+")
_LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ][A-Za-zÀ-ÖØ-öø-ɏ0-9]*")
_STOP = frozenset("the a an of to and in is are for with that this it its not on by from when if as at be or has have one".split())


#: Letters of the shortest cognate, and of its beginning that both languages must share.
COGNATE, STEM = 6, 5


@functools.lru_cache(1 << 16)
def _bare(text: str) -> str:
    return _CODE.sub(" ", text)


@functools.lru_cache(1 << 16)
def _written(text: str) -> frozenset[str]:
    """Code spans, addresses and numbers."""
    found = [("c", (m[1] or m[2]).strip().rstrip("()")) for m in _CODE.finditer(text)]
    found += [("n", m[0].rstrip(".,")) for m in _NUMBER.finditer(_bare(text))]
    return frozenset(f"{k}:{v}" for k, v in found if v)


@functools.lru_cache(1 << 16)
def _named(text: str) -> frozenset[str]:
    """Names (words in Latin letters with a capital) and the stems of other long words in Latin letters, without accents."""
    found = []
    for w in _LATIN.findall(_bare(text)):
        plain = w.casefold()
        if not plain.isascii():
            plain = "".join(c for c in unicodedata.normalize("NFD", plain) if not unicodedata.combining(c))
        if plain in _STOP:
            continue
        if len(w) > 1 and not w.islower():
            found.append("w:" + plain)
        if len(plain) >= COGNATE:
            found.append("g:" + plain[:STEM])
    return frozenset(found)


def anchors(text: str) -> frozenset[str]:
    """Code spans, addresses, numbers, names and stems of cognates. Names and stems count only where both sides of a document have them."""
    return _written(text) | _named(text)


@functools.lru_cache(1 << 16)
def words(text: str) -> list[str]:
    """Words of a sentence as lexicon keys: Latin words in lower case without function words; of other scripts the first two and three letters, as endings vary."""
    found: dict[str, None] = {}
    for w in _WORD.findall(_bare(text)):
        if w[0] < "ɐ":
            w = w.casefold()
            if w not in _STOP and len(w) > 1:
                found[w] = None
        else:
            found[w[:2]] = None
            if len(w) > 2:
                found[w[:3]] = None
    return list(found)


class Lexicon:
    """Renderings of each word both ways, with log odds against chance."""

    def __init__(self) -> None:
        self.forward: dict[str, dict[str, float]] = {}
        self.backward: dict[str, dict[str, float]] = {}

    @staticmethod
    def _model1(pairs: list[tuple[list[str], list[str]]], rounds: int = ROUNDS) -> dict[str, dict[str, float]]:
        """Log odds of t(e|f) against p(e), by e then f."""
        es, fs = {}, {}
        ei, fi, si = [], [], []
        for n, (e, f) in enumerate(pairs):
            a = [es.setdefault(x, len(es)) for x in e]
            b = [fs.setdefault(x, len(fs)) for x in f]
            for x in a:
                ei += [x] * len(b)
                fi += b
                si += [n] * len(b)
        if not ei:
            return {}
        ei, fi, si = np.array(ei), np.array(fi), np.array(si)
        link, inverse = np.unique(ei.astype(np.int64) * len(fs) + fi, return_inverse=True)
        slot, at = np.unique(ei.astype(np.int64) * len(pairs) + si, return_inverse=True)
        of_f = (link % len(fs)).astype(np.int64)
        t = np.ones(len(link))
        for _ in range(rounds):
            p = t[inverse]
            p = p / np.bincount(at, p)[at]
            count = np.bincount(inverse, p, len(link))
            t = count / (np.bincount(of_f, count, len(fs))[of_f] + 1.0)
        seen = np.bincount((slot // len(pairs)).astype(np.int64), minlength=len(es))
        return Lexicon._known(list(es), list(fs), (link // len(fs)).astype(np.int64), of_f, t, seen)

    @staticmethod
    def _known(names_e: list[str], names_f: list[str], of_e: np.ndarray, of_f: np.ndarray, t: np.ndarray, seen: np.ndarray) -> dict[str, dict[str, float]]:
        """The renderings kept, from t(e|f) of the links and the sentences that each e was seen in."""
        prior = seen / seen.sum()
        found: dict[str, dict[str, float]] = {}
        for k in np.flatnonzero(t > LEAST):
            if seen[of_e[k]] >= 3:
                found.setdefault(names_e[of_e[k]], {})[names_f[of_f[k]]] = float(min(4.0, math.log(t[k] / (prior[of_e[k]] + 1e-6))))
        known = {e: dict(sorted(v.items(), key=lambda x: (-x[1], x[0]))[:RENDERINGS]) for e, v in found.items()}
        # words seen often without a rendering count as unexplained, words hardly seen as unknown
        for e, n in zip(names_e, seen):
            if n >= 8:
                known.setdefault(e, {})
        return known

    def fit(self, pairs: list[tuple[list[str], list[str]]]) -> None:
        self.forward = self._model1(pairs)
        self.backward = self._model1([(f, e) for e, f in pairs])


def _explained(lexicon: dict[str, dict[str, float]], ours: list[list[str]], theirs: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Sum over our words of their best log odds in each of their sentences, and the number of known words."""
    where: dict[str, list[int]] = defaultdict(list)
    for j, ws in enumerate(theirs):
        for w in ws:
            where[w].append(j)
    at: dict[str, int] = {}
    row, col = [], []
    for i, ws in enumerate(ours):
        for w in ws:
            if w in lexicon:
                row.append(i)
                col.append(at.setdefault(w, len(at)))
    if not at:
        return np.zeros((len(ours), len(theirs))), np.zeros(len(ours))
    # each word once, however many sentences hold it
    best = np.full((len(at), len(theirs)), -2.5)
    for w, k in at.items():
        renderings = lexicon[w]
        for r in renderings.keys() & where.keys():
            odds = renderings[r]
            for j in where[r]:
                if odds > best[k, j]:
                    best[k, j] = odds
    held = np.zeros((len(ours), len(at)))
    held[row, col] = 1.0
    return held @ best, held.sum(1)


class Document:
    """The two sides of one document with what scoring needs."""

    def __init__(self, source: list[str], target: list[str]) -> None:
        ours, theirs = [_written(t) for t in source], [_written(t) for t in target]
        if any(_LATIN.search(_bare(t)) for t in target) and any(_LATIN.search(_bare(t)) for t in source):
            named = [_named(t) for t in source], [_named(t) for t in target]
            both = frozenset().union(*named[0]) & frozenset().union(*named[1])
            ours, theirs = ([s | (n & both) for s, n in zip(side, names)] for side, names in zip((ours, theirs), named))
        self.anchors = ours, theirs
        self.words = [words(t) for t in source], [words(t) for t in target]
        self._table: tuple[Lexicon, np.ndarray, np.ndarray] | None = None
        self.count = Counter(a for s in self.anchors[0] for a in s), Counter(a for s in self.anchors[1] for a in s)

    def weight(self, anchor: str) -> float:
        """How much a shared anchor tells: the rarer in the document and the longer, the more."""
        base = {"c": 6.0, "w": 3.0, "g": 1.0}.get(anchor[0]) or 1.5 + min(3, len(anchor) - 2)
        return base / max(1.0, math.sqrt(max(self.count[0][anchor], self.count[1][anchor])))

    def points(self) -> list[tuple[int, int, float]]:
        """Sentence pairs that share a telling anchor found once on either side."""
        at = {a: j for j, s in enumerate(self.anchors[1]) for a in s if self.count[1][a] == 1}
        found: dict[tuple[int, int], float] = defaultdict(float)
        for i, s in enumerate(self.anchors[0]):
            for a in s:
                if self.count[0][a] == 1 and a in at and (a[0] in "cw" or a[0] == "n" and len(a) > 3):
                    found[i, at[a]] += self.weight(a)
        return [(i, j, w) for (i, j), w in sorted(found.items())]

    def scores(self, lexicon: Lexicon, rows: list[int], cols: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The scores of some rows and columns. The table is computed once, as a whole, if it has no more than CELLS cells."""
        n, m = len(self.words[0]), len(self.words[1])
        if n * m > CELLS:
            return self._scores(lexicon, rows, cols)
        if self._table is None or self._table[0] is not lexicon:
            self._table = (lexicon, *self._scores(lexicon, list(range(n)), list(range(m))))
        at = np.ix_(rows, cols)
        return self._table[1][at], self._table[2][at]

    def _scores(self, lexicon: Lexicon, rows: list[int], cols: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """How well each source sentence is explained by each target sentence, and the other way: mean log odds of words and anchors, negative where they contradict."""
        a, b = [self.words[0][i] for i in rows], [self.words[1][j] for j in cols]
        forward, known_f = _explained(lexicon.forward, a, b)
        backward, known_b = _explained(lexicon.backward, b, a)
        backward = backward.T
        left, right = np.zeros_like(forward), np.zeros_like(forward)
        where: dict[str, list[int]] = defaultdict(list)
        for y, j in enumerate(cols):
            for x in self.anchors[1][j]:
                where[x].append(y)
        both = np.zeros_like(forward)
        for x, i in enumerate(rows):
            for name in self.anchors[0][i]:
                for y in where.get(name, ()):
                    both[x, y] += self.weight(name)
        total_a = np.array([sum(map(self.weight, self.anchors[0][i])) for i in rows])
        total_b = np.array([sum(map(self.weight, self.anchors[1][j])) for j in cols])
        lost_a, lost_b = total_a[:, None] - both, total_b[None, :] - both
        left = (forward + 1.5 * both - 1.5 * lost_a) / (known_f[:, None] + total_a[:, None] / 2 + 1)
        right = (backward + 1.5 * both - 1.5 * lost_b) / (known_b[None, :] + total_b[None, :] / 2 + 1)
        return left, right


def chain(points: list[tuple[int, int, float]]) -> list[tuple[int, int]]:
    """The longest strictly increasing subsequence of points (patience method); of several at one source sentence the heaviest counts."""
    best: dict[int, tuple[float, int]] = {}
    for i, j, w in points:
        if i not in best or (w, -j) > (best[i][0], -best[i][1]):
            best[i] = (w, j)
    order = [(i, j) for i, (_, j) in sorted(best.items())]
    tails: list[int] = []
    at: list[int] = []
    before = [-1] * len(order)
    for n, (_, j) in enumerate(order):
        k = bisect.bisect_left(tails, j)
        before[n] = at[k - 1] if k else -1
        if k == len(tails):
            tails.append(j)
            at.append(n)
        else:
            tails[k], at[k] = j, n
    found, n = [], at[-1] if at else -1
    while n >= 0:
        found.append(order[n])
        n = before[n]
    return found[::-1]


#: Moves inside a gap: source and target sentences taken.
_MOVES = ((1, 1), (1, 2), (2, 1), (1, 0), (0, 1))
_SKIP, _MERGE = -0.05, -0.25


def _rows(left: np.ndarray, right: np.ndarray, before: np.ndarray, scores: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """(moves, the last two rows of best sums) of the table's rows that follow `before`, the two rows before them; scores are left and right of the sentence before these rows, None at the first."""
    m = left.shape[1]
    moves = np.zeros((len(left), m + 1), np.int8)
    skips = _SKIP * np.arange(m + 1)
    older, old = before
    for i in range(len(left)):
        l, r = left[i], right[i]
        best, move = old + _SKIP, np.full(m + 1, 3, np.int8)
        others = [(0, old[:-1] + (l + r) / 2, 1)]
        if m > 1:
            others.append((1, old[:-2] + np.where(np.minimum(r[:-1], r[1:]) > 0.3, r[:-1] + r[1:] + _MERGE, -9.0), 2))
        if scores is not None:
            others.append((2, older[:-1] + np.where(np.minimum(scores[0], l) > 0.3, scores[0] + l + _MERGE, -9.0), 1))
        for k, sums, at in reversed(others):
            better = sums >= best[at:]
            best[at:][better], move[at:][better] = sums[better], k
        # skips of target sentences: the best sum to the left, less what lies between
        level = best - skips
        top = np.maximum.accumulate(level)
        skipped = top > level
        best[skipped], move[skipped] = (top + skips)[skipped], 4
        moves[i] = move
        older, old, scores = old, best, (l, r)
    return moves, np.stack([older, old])


def gap_by_rows(n: int, m: int, scores: Callable[[int, int], tuple[np.ndarray, np.ndarray]], cells: int = CELLS) -> list[tuple[int, int]]:
    """Links inside one gap by dynamic programming over the moves, over the whole table; scores(a, b) gives left and right of the source sentences from a to b.

    The table is filled in blocks of about `cells` cells. Only the sums at the edges of blocks are kept; the moves
    of a block are found again on the way back, so a long gap takes twice the time but not its table's memory.
    """
    if not n or not m:
        return []
    step = max(1, cells // (m + 1))
    starts = list(range(0, n, step))
    edges, before, row, moves = [], np.stack([np.full(m + 1, -1e18), _SKIP * np.arange(m + 1)]), None, None
    for a in starts:
        edges.append((before, row))
        left, right = scores(a, min(n, a + step))
        moves, before = _rows(left, right, before, row)
        row = left[-1], right[-1]
    links, i, j, block = [], n, m, len(starts) - 1
    while i and j:
        while i <= starts[block]:
            block, moves = block - 1, None
        if moves is None:
            moves, _ = _rows(*scores(starts[block], min(n, starts[block] + step)), *edges[block])
        a, b = _MOVES[moves[i - 1 - starts[block], j]]
        links += [(i - 1 - x, j - 1 - y) for x in range(a) for y in range(b)]
        i, j = i - a, j - b
    return links


def gap(left: np.ndarray, right: np.ndarray, cells: int = CELLS) -> list[tuple[int, int]]:
    """The same from scores at hand."""
    return gap_by_rows(*left.shape, lambda a, b: (left[a:b], right[a:b]), cells)


#: Mean log odds from which a pair counts as a translation: of both sides together, and of one side for a part.
WHOLE, PART = 1.3, 1.6


#: The same while the lexicon is still being learned, when most words are unknown.
LEARNING = 0.45, 0.9


def align(source: list[str], target: list[str], lexicon: Lexicon, least: tuple[float, float] = (WHOLE, PART)) -> list[tuple[int, int]]:
    """Links between sentence positions; least: mean log odds of a whole pair and of a part."""
    least_whole, least_part = least
    if not source or not target:
        return []
    doc = Document(source, target)
    points = doc.points()
    fixed = chain(points)
    links: set[tuple[int, int]] = set()
    edges = [(-1, -1), *fixed, (len(source), len(target))]
    for (i0, j0), (i1, j1) in zip(edges, edges[1:]):
        rows, cols = list(range(i0 + 1, i1)), list(range(j0 + 1, j1))
        if rows and cols:
            found = gap_by_rows(len(rows), len(cols), lambda a, b, rows=rows, cols=cols: doc.scores(lexicon, rows[a:b], cols))
            links |= {(rows[x], cols[y]) for x, y in found}

    def value(i: int, j: int) -> tuple[float, float]:
        if doc._table is not None:
            return float(doc._table[1][i, j]), float(doc._table[2][i, j])
        a, b = doc.scores(lexicon, [i], [j])
        return float(a[0, 0]), float(b[0, 0])

    def good(i: int, j: int) -> bool:
        a, b = value(i, j)
        return (a + b) / 2 > least_whole or (max(a, b) > least_part and min(a, b) > -0.5)

    links = {x for x in links if good(*x)}
    # anchor points, those off the chain included: a moved sentence keeps its anchors
    links |= {(i, j) for i, j, w in points if good(i, j)}

    def left_over() -> tuple[list[int], list[int]]:
        with_row, with_col = {x for x, _ in links}, {y for _, y in links}
        return [i for i in range(len(source)) if i not in with_row], [j for j in range(len(target)) if j not in with_col]

    def attach() -> None:
        """A sentence left over beside a linked one may be a part of a merge or split."""
        rows, cols = left_over()
        by_row, by_col = defaultdict(set), defaultdict(set)
        for i, j in links:
            by_row[i].add(j)
            by_col[j].add(i)
        extra = {(i, j) for i in rows for k in (i - 1, i + 1) for j in by_row.get(k, ()) if value(i, j)[0] > least_part}
        extra |= {(i, j) for j in cols for k in (j - 1, j + 1) for i in by_col.get(k, ()) if value(i, j)[1] > least_part}
        links.update(extra)

    attach()
    rows, cols = left_over()
    # moved sentences: best pairs first among what is left, in blocks
    found = []
    for at in range(0, len(rows), 256):
        part = rows[at : at + 256]
        for to in range(0, len(cols), 256):
            other = cols[to : to + 256]
            left, right = doc.scores(lexicon, part, other)
            mean = (left + right) / 2
            found += [(float(mean[x, y]), part[x], other[y]) for x, y in zip(*np.nonzero((mean > least_whole) | ((np.maximum(left, right) > least_part) & (np.minimum(left, right) > -0.3))))]
    used_i, used_j = set(), set()
    for _, i, j in sorted(found, key=lambda x: (-x[0], x[1], x[2])):
        if i not in used_i and j not in used_j:
            links.add((i, j))
            used_i.add(i)
            used_j.add(j)
    attach()
    return _needed(doc, lexicon, source, target, links)


#: Mean log odds by which a further part must add to what the first explains.
GAIN = 0.3


def _needed(doc: Document, lexicon: Lexicon, source: list[str], target: list[str], links: set[tuple[int, int]]) -> list[tuple[int, int]]:
    """Without the links to further parts that explain nothing more than the best part does."""
    by_row, by_col = defaultdict(set), defaultdict(set)
    for i, j in links:
        by_row[i].add(j)
        by_col[j].add(i)
    drop: set[tuple[int, int]] = set()
    for i, js in sorted(by_row.items()):
        if len(js) > 1:
            order = sorted(js)
            left, right = doc.scores(lexicon, [i], order)
            kept = [int(np.argmax(left[0] + right[0]))]
            for y in sorted(set(range(len(order))) - set(kept), key=lambda y: -right[0, y]):
                whole = " ".join(target[order[x]] for x in kept)
                both = Document([source[i]], [whole, whole + " " + target[order[y]]]).scores(lexicon, [0], [0, 1])[0][0]
                if both[1] - both[0] >= GAIN:
                    kept.append(y)
                else:
                    drop.add((i, order[y]))
    for j, is_ in sorted(by_col.items()):
        is_ = {i for i in is_ if (i, j) not in drop}
        if len(is_) > 1:
            order = sorted(is_)
            left, right = doc.scores(lexicon, order, [j])
            kept = [int(np.argmax(left[:, 0] + right[:, 0]))]
            for x in sorted(set(range(len(order))) - set(kept), key=lambda x: -left[x, 0]):
                whole = " ".join(source[order[y]] for y in kept)
                both = Document([whole, whole + " " + source[order[x]]], [target[j]]).scores(lexicon, [0, 1], [0])[1][:, 0]
                if both[1] - both[0] >= GAIN:
                    kept.append(x)
                else:
                    drop.add((order[x], j))
    return sorted(links - drop)


def fit_lexicon(documents: list[tuple[list[str], list[str]]], rounds: int = FITS) -> Lexicon:
    """First from sentences that share anchors, then from the links that the lexicon so far gives."""
    lexicon = Lexicon()
    pairs = []
    for source, target in documents:
        doc = Document(source, target)
        pairs += [(doc.words[0][i], doc.words[1][j]) for i, j, _ in doc.points()]
    lexicon.fit(pairs)
    for _ in range(rounds - 1):
        pairs = []
        for source, target in documents:
            pairs += [(words(source[i]), words(target[j])) for i, j in align(source, target, lexicon, LEARNING)]
        lexicon.fit(pairs)
    return lexicon


def _side(value: list[dict] | None) -> tuple[list[int], list[str]]:
    rows = sorted(((r["idx"], r["text"] or "") for r in value or [] if r is not None and r["idx"] is not None), key=lambda x: x[0])
    return [i for i, _ in rows], [t for _, t in rows]


def _lacking(named: DataFrame, last: int) -> DataFrame:
    """Hashes of documents, SEEN a word, of the words that SEEN documents or more hold but fewer than SEEN of those with a hash up to `last`. Words are counted over all documents, reduced map-side."""
    sides = F.concat_ws(" ", F.concat_ws(" ", F.transform("source", lambda s: s["text"])), F.concat_ws(" ", F.transform("target", lambda s: s["text"])))
    word = F.array_distinct(F.transform(F.regexp_extract_all(F.lower(F.regexp_replace(sides, r"`[^`\n]+`|https?://[^\s`)]+", " ")), F.lit(r"(\p{L}{2,})"), 1), lambda w: F.when(w > "ɐ", F.substring(w, 1, 3)).otherwise(w)))
    held = named.select("_h", F.explode(word).alias("w"))
    picks = [F.min(F.struct(F.xxhash64("_h", F.lit(k)), "_h"))["_h"].alias(f"p{k}") for k in range(SEEN)]
    rare = held.groupBy("w").agg(F.count("*").alias("n"), F.count_if(F.col("_h") <= F.lit(last)).alias("known"), *picks).filter((F.col("n") >= SEEN) & (F.col("known") < SEEN))
    return rare.select(F.explode(F.array(*(f"p{k}" for k in range(SEEN)))).alias("_h")).distinct()


def sample(named: DataFrame, bound: int = SAMPLE, more: int = MORE) -> list[tuple[list[str], list[str]]]:
    """The documents that the lexicon is fitted on: `bound` by the hash of their key, and up to `more` that hold words which those lack."""
    rows = named.filter((F.size("source") > 0) & (F.size("target") > 0)).withColumn("_h", F.xxhash64("doc")).select("_h", "source", "target")
    known = rows.orderBy("_h").limit(bound).collect()
    if len(known) == bound:
        wanted = _lacking(rows, known[-1]["_h"]).orderBy("_h").limit(more)
        known += rows.filter(F.col("_h") > F.lit(known[-1]["_h"])).join(F.broadcast(wanted), "_h", "left_semi").orderBy("_h").limit(more).collect()
    return [(_side(r["source"])[1], _side(r["target"])[1]) for r in known]


def _documents(batches: Iterable[pa.RecordBatch], lexicon: Lexicon | None) -> Iterator[list[tuple]]:
    """(key, idx and texts of both sides, lexicon) of each document, 256 at a time; without a lexicon for all, a fourth column holds that of each document."""
    for whole in batches:
        for at in range(0, max(1, whole.num_rows), 256):
            batch = whole.slice(at, 256)
            columns = [batch.column(i).to_pylist() for i in range(3)]
            own = [lexicon] * batch.num_rows if batch.num_columns == 3 else [_lexicon_of(x) for x in batch.column(3).to_pylist()]
            yield [(doc, _side(s), _side(t), x) for doc, s, t, x in zip(*columns, own)]


def _lexicon_of(rows: list[dict] | None) -> Lexicon:
    lexicon = Lexicon()
    for r in rows or []:
        (lexicon.backward if r["side"] else lexicon.forward)[r["w"]] = {x["f"]: x["odds"] for x in r["renderings"]}
    return lexicon


def _supplied(named: DataFrame, lexicon: Lexicon | DataFrame | None) -> tuple[DataFrame, Callable[[], Lexicon | None]]:
    """The documents and how a task gets their lexicon: broadcast, or joined to each document as the entries of its words."""
    if not isinstance(lexicon, DataFrame):
        shared = named.sparkSession.sparkContext.broadcast(lexicon)
        return named, lambda: shared.value

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, *sides in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for k, side in enumerate(sides):
                    ws = sorted({w for t in _side(side)[1] for w in words(t)})
                    yield pa.RecordBatch.from_arrays([pa.array([h] * len(ws), pa.int64()), pa.array([k] * len(ws), pa.int32()), pa.array(ws, pa.string())], names=["_h", "side", "w"])

    # documents whose hashes clash get the entries of both, which are true for both
    hashed = named.withColumn("_h", F.xxhash64("source", "target"))
    entries = hashed.select("_h", "source", "target").mapInArrow(held, "_h long, side int, w string").distinct().join(lexicon, ["side", "w"])
    entries = entries.groupBy("_h").agg(F.collect_list(F.struct("side", "w", "renderings")).alias("lexicon"))
    return hashed.join(entries, "_h", "left").select("doc", "source", "target", "lexicon"), lambda: None


def sentence_pairs(named: DataFrame, lexicon: Lexicon | DataFrame | None) -> DataFrame:
    """(a, b): words of each pair of sentences to fit on, by the lexicon so far or, without one, by shared anchors."""
    supplied, get = _supplied(named, lexicon)
    first = lexicon is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for documents in _documents(batches, get()):
            a, b = [], []
            for _, (_, source), (_, target), own in documents:
                for i, j, *_ in Document(source, target).points() if first else align(source, target, own, LEARNING):
                    x, y = words(source[i]), words(target[j])
                    if x and y:
                        a.append(x)
                        b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.list_(pa.string())), pa.array(b, pa.list_(pa.string()))], names=["a", "b"])

    return supplied.mapInArrow(run, "a array<string>, b array<string>")


def _flat(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets of the lists, from 0 on, and their items."""
    return np.concatenate([[0], np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))]).astype(np.int64), column.flatten()


def _expected(batch: pa.RecordBatch, width: int, known: tuple[np.ndarray, ...] | None, place: Callable[[np.ndarray], np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys (e * width + f) or places of links, and their expected counts in these pairs both ways, by t(e|f) and t(f|e) known so far (even at first)."""
    (a_at, a), (b_at, b) = _flat(batch.column(0)), _flat(batch.column(1))
    a, b = a.to_numpy().astype(np.int64), b.to_numpy().astype(np.int64)
    pair = np.repeat(np.arange(batch.num_rows), np.diff(a_at))
    many = np.diff(b_at)[pair]
    start = np.cumsum(many) - many
    at_b = np.arange(int(many.sum())) + np.repeat(b_at[pair] - start, many)
    key = np.repeat(a * width, many) + b[at_b]
    if known is None:
        link, at = np.unique(key, return_inverse=True)
        p = q = np.ones(len(key))
    else:
        link = at = place(key)
        p, q = known[1][at], known[2][at]
    p = p / np.repeat(np.add.reduceat(p, start), many)
    q = q / np.bincount(at_b, q, len(b))[at_b]
    size = len(link) if known is None else len(known[0])
    return link, np.bincount(at, p, size), np.bincount(at, q, size)


def _portions(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about `most` pairs of words."""
    cells = np.cumsum(pc.list_value_length(batch.column(0)).to_numpy().astype(np.int64) * pc.list_value_length(batch.column(1)).to_numpy())
    at = 0
    while at < batch.num_rows:
        done = cells[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(cells, done + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def _merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key, at = np.unique(np.concatenate([x[0] for x in parts]), return_inverse=True)
    return key, np.bincount(at, np.concatenate([x[1] for x in parts])), np.bincount(at, np.concatenate([x[2] for x in parts]))


#: Possible links up to which a table by key finds a link's place.
_TABLE = 1 << 22


def _counted(pairs: DataFrame, width: int, height: int, shared: Broadcast) -> DataFrame:
    """(key, c, d): expected counts of each link both ways over all pairs, added up in each task first; shared: keys and probabilities so far, None at first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(key: np.ndarray, c: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(c), pa.array(d)], names=["key", "c", "d"])

        table = shared.value
        if table is None:
            held, pending = [], 0
            for batch in batches:
                for part in _portions(batch, CELLS):
                    held.append(_expected(part, width, None, None))
                    pending += len(held[-1][0])
                    if pending > max(CELLS, len(held[0][0])):
                        held, pending = [_merged(held)], 0
                        if len(held[0][0]) > LINKS:
                            yield rows(*held.pop())
            if held:
                yield rows(*_merged(held))
            return
        if width * height <= _TABLE:
            places = np.zeros(width * height, np.int32)
            places[table[0]] = np.arange(len(table[0]))
            place = places.__getitem__
        else:
            place = functools.partial(np.searchsorted, table[0])
        c, d = np.zeros(len(table[0])), np.zeros(len(table[0]))
        for batch in batches:
            for part in _portions(batch, CELLS):
                _, x, y = _expected(part, width, table, place)
                c += x
                d += y
        kept = np.flatnonzero((c > 0) | (d > 0))
        for at in range(0, len(kept), 1 << 16):
            yield rows(*(x[kept[at : at + (1 << 16)]] for x in (table[0], c, d)))

    # a task a core: each sends every link it met, so more tasks would shuffle more
    few = pairs.coalesce(pairs.sparkSession.sparkContext.defaultParallelism)
    return few.mapInArrow(run, "key long, c double, d double").groupBy("key").agg(F.sum("c").alias("c"), F.sum("d").alias("d"))


def _fit_broadcast(pairs: DataFrame, seen: list, links: int) -> Lexicon | None:
    """Model 1 both ways: pairs stay where they are, the links' probabilities are sent to them; None if there are more than `links` links."""
    names = [sorted(r["w"] for r in seen if r["side"] == k) for k in (0, 1)]
    counts = [{r["w"]: r["n"] for r in seen if r["side"] == k} for k in (0, 1)]
    height, width = map(len, names)
    if not width:
        return Lexicon()
    vocabulary = pairs.sparkSession.sparkContext.broadcast(names)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = [pa.array(x, pa.string()) for x in vocabulary.value]
        for batch in batches:
            columns = []
            for k in (0, 1):
                at, flat = _flat(batch.column(k))
                columns.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pc.index_in(flat.cast(pa.string()), value_set=values[k])))
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b"])

    coded = checkpoint(pairs.select("a", "b").mapInArrow(encode, "a array<int>, b array<int>"))
    known = None
    for _ in range(ROUNDS):
        shared = coded.sparkSession.sparkContext.broadcast(known)
        counted = _counted(coded, width, height, shared)
        if known is None:
            counted = checkpoint(counted)
            if counted.count() > links:
                return None
        got = counted.toArrow()
        shared.unpersist()
        key, c, d = (got.column(k).to_numpy() for k in ("key", "c", "d"))
        if known is None:
            order = np.argsort(key)
            key, c, d = key[order], c[order], d[order]
        else:
            at = np.searchsorted(known[0], key)
            c, d = np.bincount(at, c, len(known[0])), np.bincount(at, d, len(known[0]))
            key = known[0]
        e, f = key // width, key % width
        known = key, c / (np.bincount(f, c, width)[f] + 1.0), d / (np.bincount(e, d, height)[e] + 1.0)
    lexicon = Lexicon()
    n, m = (np.array([counts[k][w] for w in names[k]]) for k in (0, 1))
    lexicon.forward = Lexicon._known(names[0], names[1], e, f, known[1], n)
    lexicon.backward = Lexicon._known(names[1], names[0], f, e, known[2], m)
    return lexicon


def _fit_joined(pairs: DataFrame, seen: DataFrame) -> DataFrame:
    """The same by joins, whatever the number of words and links: (side, w, renderings)."""
    numbered = checkpoint(pairs.select(F.monotonically_increasing_id().alias("s"), "a", "b"))
    found = []
    for side, (a, b) in enumerate((("a", "b"), ("b", "a"))):
        cells = checkpoint(numbered.select("s", F.explode(a).alias("w"), b).select("s", "w", F.explode(b).alias("f")))
        t = None
        for _ in range(ROUNDS):
            held = cells.withColumn("t", F.lit(1.0)) if t is None else cells.join(t, ["w", "f"])
            share = F.col("t") / F.sum("t").over(Window.partitionBy("s", "w"))
            count = checkpoint(held.select("w", "f", share.alias("c")).groupBy("w", "f").agg(F.sum("c").alias("c")))
            total = count.groupBy("f").agg(F.sum("c").alias("total"))
            t = checkpoint(count.join(total, "f").select("w", "f", (F.col("c") / (F.col("total") + 1.0)).alias("t")))
        ours = seen.filter(F.col("side") == side).select("w", "n")
        whole = ours.agg(F.sum("n")).first()[0]
        odds = F.least(F.lit(4.0), F.log(F.col("t") / (F.col("n") / F.lit(whole) + 1e-6)))
        place = F.row_number().over(Window.partitionBy("w").orderBy(F.desc("odds"), "f"))
        kept = t.filter(F.col("t") > LEAST).join(ours.filter("n >= 3"), "w").select("w", "f", odds.alias("odds")).withColumn("_p", place).filter(F.col("_p") <= RENDERINGS)
        kept = kept.groupBy("w").agg(F.collect_list(F.struct("f", "odds")).alias("renderings"))
        known = ours.join(kept, "w", "left").filter("renderings is not null or n >= 8")
        found.append(known.select(F.lit(side).alias("side"), "w", F.coalesce("renderings", F.expr("cast(array() as array<struct<f:string,odds:double>>)")).alias("renderings")))
    return checkpoint(found[0].unionByName(found[1]))


def fit_documents(named: DataFrame, most: int = WORDS, links: int = LINKS) -> Lexicon | DataFrame:
    """The lexicon that `fit_lexicon` gives, of all documents (doc, source, target); rows (side, w, renderings) with more than `most` words or `links` links."""
    lexicon: Lexicon | DataFrame | None = None
    for _ in range(FITS):
        pairs = checkpoint(sentence_pairs(named, lexicon))
        sides = (pairs.select(F.lit(k).alias("side"), F.explode(x).alias("w")) for k, x in enumerate("ab"))
        seen = checkpoint(functools.reduce(DataFrame.unionByName, sides).groupBy("side", "w").agg(F.count("*").alias("n")))
        few = seen.limit(most + 1).collect()
        lexicon = _fit_broadcast(pairs, few, links) if len(few) <= most else None
        if lexicon is None:
            lexicon = _fit_joined(pairs, seen)
    return lexicon


def align_documents(documents: DataFrame, key: str, source: str = "source", target: str = "translation", most: int = WORDS, links: int = LINKS) -> DataFrame:
    """(key, source_idx, translation_idx): one row for each pair of sentences that translate each other, wholly or in part.

    Null or empty sides, null sentences and blank texts give no rows; sentences are read in the order of idx.
    Repeated rows give repeated rows. Other columns are dropped, so theirs can't clash.
    The lexicon is fitted on all documents; most, links: bounds up to which it is broadcast, not joined.
    """
    named = documents.select(F.col(key).alias("doc"), F.col(source).alias("source"), F.col(target).alias("target"))
    supplied, get = _supplied(named, fit_documents(named, most, links))
    kind = documents.schema[key].dataType.simpleString()
    arrow_kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(kind, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _documents(batches, get()):
            keys, a, b = [], [], []
            for doc, (si, st), (ti, tt), lexicon in part:
                for i, j in align(st, tt, lexicon):
                    keys.append(doc)
                    a.append(si[i])
                    b.append(ti[j])
            yield pa.RecordBatch.from_arrays([pa.array(keys, arrow_kind), pa.array(a, pa.int32()), pa.array(b, pa.int32())], names=[key, "source_idx", "translation_idx"])

    return supplied.mapInArrow(run, f"`{key}` {kind}, source_idx int, translation_idx int")
