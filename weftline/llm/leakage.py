"""Evaluation texts that leaked into a corpus, by q-gram lemma filtering.

Texts become streams of letters and digits, free of case, punctuation, white space, character forms
and markup. A passage of twelve words of an item, or an item within its edit budget, must share a
known number of q-grams with the document in a band of neighbouring diagonals: the q-grams of the item less
those that its edit budget can destroy (the q-gram lemma). Only regions that
do are verified, by exact search for whole runs of words and by alignment inside the band.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import checkpoint

#: Length of the q-grams (a power of two, so that hashes double up).
Q = 8
#: Consecutive words that make a leak, and how many of them must lie outside sentences that items share.
RUN, OWN = 12, 8
#: A sentence is shared if a run of RUN words of it is in so many items; copies of one item count once.
SHARED = 3
#: Items are copies of each other if so much of the longer one is found in order in the other.
COPY = 0.9
#: Share of the item's own words that must be found in order for a leak of the whole item with changes.
COVER = 0.76
#: q-grams in more items than this are left out of the index, as long as each run keeps LEAST others; the bounds count what is kept.
COMMON, LEAST = 100, 20
#: Least width of a diagonal band in characters; an item's band is as wide as its edit budget. Neighbouring bands are counted together, so they overlap by half.
BAND = 64
#: Characters of the items in one index, which bounds what is broadcast; more are searched block by block.
BLOCK = 4_000_000
#: Longer streams are searched in windows of this length that overlap by the longest item.
WINDOW = 1 << 20

#: A tag of any length: a name and attributes, or a name and something that begins as an attribute with a value. Possessive, so that a text is read once.
_TAG = re.compile(
    r"""</?[A-Za-z][\w:.-]*+(?:\s++(?:[\w:@.#*\[\]()-]++(?:\s*+=\s*+(?:"[^"<]*+"|'[^'<]*+'|[^\s"'<>=`]++))?+|/))*+\s*+>"""
    r"""|</?[A-Za-z][\w:.-]*+\s++[^<>=\s]++\s*+=[^<>]*+>"""
)
_TEX = re.compile(r"\\[A-Za-z]+\*?")
_LINK = re.compile(r"\]\([^()\s]*\)|\]\[[^\[\]\n]*\]|(?<![A-Za-z]):[a-z]+:(?=`)")
_OTHER = re.compile(r"[\W_]+")
_ASCII_OTHER = {i: None for i in range(128) if not chr(i).isalnum()}
_BASE = np.uint64(0x9E3779B97F4A7C15)


def without_tags(text: str) -> str:
    """The text without tags and comments of any length, in one pass."""
    at = text.find("<!--")
    if at >= 0:
        kept, done = [], 0
        while at >= 0 and (end := text.find("-->", at + 4)) >= 0:
            kept.append(text[done:at])
            done = end + 3
            at = text.find("<!--", done)
        text = "".join(kept) + text[done:]
    return _TAG.sub("", text)


def unmarked(text: str) -> str:
    """The text without markup that may stand between its words, in one character form and case."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = without_tags(text)
    if "\\" in text:
        text = _TEX.sub("", text)
    if "](" in text or "][" in text or ":`" in text:
        text = _LINK.sub("", text)
    return text.casefold()


def squeezed(text: str) -> str:
    """Letters and digits only."""
    return text.translate(_ASCII_OTHER) if text.isascii() else _OTHER.sub("", text)


def stream_words(text: str) -> list[str]:
    """Words between white space, each squeezed."""
    return [w for w in (squeezed(w) for w in unmarked(text).split()) if w]


def qgram_hashes(codes: np.ndarray) -> np.ndarray:
    """The hash of the q-gram at every position."""
    h, base, n = codes.astype(np.uint64), _BASE, 1
    while n < Q:
        h = h[:-n] * base + h[n:] if len(h) > n else h[:0]
        base, n = np.uint64(int(base) ** 2 & 0xFFFFFFFFFFFFFFFF), n * 2
    return h * np.uint64(0xBF58476D1CE4E5B9)


def _codes(stream: str) -> np.ndarray:
    return np.frombuffer(stream.encode("utf-32-le", "replace"), np.uint32)


@dataclass
class Item:
    """One held-out text."""

    key: object
    words: list[str]
    own: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))

    def __post_init__(self) -> None:
        self.stream = "".join(self.words)
        self.starts = np.cumsum([0, *map(len, self.words)])

    def budget(self) -> int:
        """Own words that may be changed, added or dropped in a leak of the whole item."""
        own = int(self.own.sum())
        return own - math.ceil(COVER * own)

    def slack(self) -> int:
        """Characters by which that many words of usual length shift the rest of the text."""
        return math.ceil(self.budget() * len(self.stream) / max(1, len(self.words)))


class Index:
    """The informative q-grams of all items, sorted by hash."""

    BITS = 22

    def __init__(self, items: list[tuple[object, str]], shared: dict[object, list[int]] | None = None) -> None:
        """shared: the places of each item's runs that SHARED or more of all items hold, copies counted once; without it these items are all."""
        self.items = [Item(k, stream_words(t)) for k, t in items]
        runs: dict[tuple[str, ...], set[object]] = defaultdict(set)
        if shared is None:
            for item in self.items:
                for i in range(len(item.words) - RUN + 1):
                    runs[tuple(item.words[i : i + RUN])].add(item.key)
        if shared is None:
            group = self._groups(runs)
            runs = {r: {group.get(k, k) for k in keys} if len(keys) >= SHARED else keys for r, keys in runs.items()}
        for item in self.items:
            item.own = np.ones(len(item.words), bool)
            places = shared.get(item.key, ()) if shared is not None else [i for i in range(len(item.words) - RUN + 1) if len(runs[tuple(item.words[i : i + RUN])]) >= SHARED]
            for i in places:
                item.own[i : i + RUN] = False
        hashes = [qgram_hashes(_codes(item.stream)) for item in self.items]
        spread = Counter(h for hs in hashes for h in np.unique(hs).tolist())
        kept_h, kept_n, kept_p = [], [], []
        #: Shared q-grams from which an item's region may hold one of its runs, and from which it may hold the whole item with changes.
        self.enough_run, self.enough_whole = np.zeros(len(self.items), np.int64), np.zeros(len(self.items), np.int64)
        self.width = np.full(len(self.items), BAND, np.int64)
        for n, (item, hs) in enumerate(zip(self.items, hashes)):
            if not len(hs):
                continue
            often = np.array([spread[h] for h in hs.tolist()])
            mine = np.r_[0, np.cumsum(np.repeat(item.own, np.diff(item.starts)))]
            keep = (often <= COMMON) & (mine[Q:] > mine[: len(hs)])
            least = len(hs)
            for i in range(max(1, len(item.words) - RUN + 1)):
                if i + RUN <= len(item.words) and item.own[i : i + RUN].sum() < OWN:
                    continue
                a, b = item.starts[i], max(item.starts[i] + 1, item.starts[min(len(item.words), i + RUN)] - Q + 1)
                here = keep[a:b]
                if here.sum() < LEAST:
                    order = np.argsort(often[a:b], kind="stable")[:LEAST]
                    here[order] = True
                least = min(least, int(keep[a:b].sum()))
            at = np.flatnonzero(keep)
            kept_h.append(hs[at])
            kept_n.append(np.full(len(at), n))
            kept_p.append(at)
            # q-gram lemma: a run of RUN words keeps all its q-grams; a changed item all but those that its changed
            # words touch, of which the edit budget allows so many
            upto = np.r_[0, np.cumsum(keep)]
            first, last = np.maximum(0, item.starts[:-1] - Q + 1), np.minimum(len(keep), item.starts[1:])
            touched = np.sort((upto[np.maximum(first, last)] - upto[np.minimum(first, len(keep))])[item.own])[::-1]
            self.enough_run[n], self.enough_whole[n] = max(1, least), max(1, len(at) - int(touched[: item.budget()].sum()))
            self.width[n] = max(BAND, item.slack())
        h = np.concatenate(kept_h) if kept_h else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.hash = h[order]
        self.item = np.concatenate(kept_n)[order].astype(np.int32) if kept_n else np.zeros(0, np.int32)
        self.position = np.concatenate(kept_p)[order].astype(np.int32) if kept_p else np.zeros(0, np.int32)
        self.seen = np.zeros(1 << self.BITS, bool)
        self.seen[self.hash >> np.uint64(64 - self.BITS)] = True
        self.runs: dict[int, list[str]] = {}
        self.longest = max((len(i.stream) for i in self.items), default=0)
        self.widest = int(self.width.max(initial=BAND))

    def _groups(self, runs: dict[tuple[str, ...], set[object]]) -> dict[object, object]:
        """One key for all copies, of those that have any. Items are compared with the first item of each run they share, not with each other."""
        words: dict[object, list[list[str]]] = defaultdict(list)
        for item in self.items:
            words[item.key].append(item.words)
        at = {k: n for n, k in enumerate(words)}
        pairs = set()
        for keys in runs.values():
            if len(keys) >= SHARED:
                first = min(keys, key=at.__getitem__)
                pairs |= {(first, k) for k in keys if k != first}
        return united((a, b) for a, b in pairs if any(copies(x, y) for x in words[a] for y in words[b]))

    def regions(self, streams: list[str]) -> list[tuple[int, ...]]:
        """(stream, item, first, last position, first, last diagonal, whole) of every region with enough shared q-grams.

        Where whole is 0 a single diagonal has those of a run, where it is 1 a band of diagonals those of the changed item;
        a q-gram of the item counts once a band, however often the band has it.
        """
        # Q zeros between streams: no q-gram of an item holds one
        gap = "\0" * Q
        codes = _codes(gap.join(streams) + gap)
        if len(codes) < Q or not len(self.hash):
            return []
        h = qgram_hashes(codes)
        at = np.flatnonzero(self.seen[h >> np.uint64(64 - self.BITS)])
        left = np.searchsorted(self.hash, h[at], "left")
        right = np.searchsorted(self.hash, h[at], "right")
        n = right - left
        at, left, n = at[n > 0], left[n > 0], n[n > 0]
        if not len(at):
            return []
        sizes = np.array([len(s) + Q for s in streams])
        first = np.cumsum(sizes) - sizes
        slot = np.repeat(left, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        item = self.item[slot].astype(np.int64)
        doc = np.repeat(np.searchsorted(first, at, "right") - 1, n)
        # only pairs of a stream and an item that share enough at all are looked at by diagonals
        pair = doc * len(self.items) + item
        enough = np.minimum(self.enough_run, self.enough_whole)
        keep = np.flatnonzero(np.bincount(pair, minlength=len(streams) * len(self.items))[pair] >= enough[item])
        if not len(keep):
            return []
        pos, ipos, pair, item = np.repeat(at, n)[keep], self.position[slot[keep]].astype(np.int64), pair[keep], item[keep]
        diagonal = pos - first[doc[keep]] - ipos + self.longest
        found: list[tuple[int, ...]] = []

        def gather(keys: np.ndarray, wide: int, places: np.ndarray | None, where: np.ndarray, across: np.ndarray, least: np.ndarray, whole: int) -> None:
            order = np.argsort(keys if places is None else keys * np.int64(self.longest + 1) + places, kind="stable")
            keys, where, across = keys[order], where[order], across[order]
            edge = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            if places is None:
                count = np.diff(np.r_[edge, len(keys)])
            else:
                places = places[order]
                count = np.add.reduceat(np.r_[True, (keys[1:] != keys[:-1]) | (places[1:] != places[:-1])], edge, dtype=np.int64)
            owner = keys[edge] // wide
            good = count >= least[owner % len(self.items)]
            if good.any():
                d = owner[good] // len(self.items)
                ends = (f.reduceat(x, edge)[good] - shift for x, shift in ((where, first[d]), (across, self.longest)) for f in (np.minimum, np.maximum))
                found.extend(zip(d.tolist(), (owner[good] % len(self.items)).tolist(), *(x.tolist() for x in ends), [whole] * len(d)))

        wide = int(diagonal.max()) + 1
        gather(pair * wide + diagonal, wide, None, pos, diagonal, self.enough_run, 0)
        band = diagonal // self.width[item] + 1
        wide = int(band.max()) + 2
        gather(np.r_[pair * wide + band, pair * wide + band - 1], wide, np.r_[ipos, ipos], np.r_[pos, pos], np.r_[diagonal, diagonal], self.enough_whole, 1)
        return found

    def holds(self, number: int, stream: str, words: list[str], bounds: np.ndarray, lo: int, hi: int, low: int, high: int, whole: int) -> bool:
        """Verify one region of a document's stream between two positions and two diagonals; words and bounds are its words and their ends in the stream."""
        item = self.items[number]
        slack = len(item.stream) + int(self.width[number])
        region = stream[max(0, lo - slack) : hi + Q + slack]
        n = len(item.words)
        own = int(item.own.sum())
        if not whole:
            if number not in self.runs:
                self.runs[number] = ["".join(item.words[i : i + RUN]) for i in range(n - RUN + 1) if item.own[i : i + RUN].sum() >= OWN]
            return any(run in region for run in self.runs[number])
        if own < RUN:
            # an item of fewer own words can only leak whole
            return bool(n) and own > 0 and item.stream in region
        a, b = np.searchsorted(bounds, max(0, lo - slack), "right"), np.searchsorted(bounds, hi + Q + slack, "left") + 1
        ours, theirs = [w for w, o in zip(item.words, item.own) if o], words[a:b]
        present = set(theirs)
        if sum(w in present for w in ours) < COVER * own:
            return False
        # banded alignment: a word meets the item's words on the region's diagonals, give or take the edit budget
        starts = item.starts[:-1][item.own]
        begin = np.r_[0, bounds][a:b]
        shift = int(self.width[number])
        band = np.searchsorted(starts, begin - high - shift, "left"), np.searchsorted(starts, begin - low + shift, "right")
        return common_in_order(ours, theirs, band) >= COVER * own


def common_in_order(a: list[str], b: list[str], band: tuple[np.ndarray, np.ndarray] | None = None) -> int:
    """Length of the longest common subsequence, bit-parallel over a; with a band, the word of b at j may only meet the words of a from band[0][j] to band[1][j]."""
    where: dict[str, int] = defaultdict(int)
    for i, w in enumerate(a):
        where[w] |= 1 << i
    full = (1 << len(a)) - 1
    v = full
    first, last = (x.tolist() for x in band) if band else ((), ())
    for j, w in enumerate(b):
        m = where.get(w)
        if m and band:
            m &= ((1 << last[j]) - 1) >> first[j] << first[j] if j < len(last) else 0
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def copies(a: list[str], b: list[str]) -> bool:
    """Exact or near copies: COPY of the longer text in order in the other."""
    least = COPY * max(len(a), len(b))
    return min(len(a), len(b)) >= least and (a == b or common_in_order(a, b) >= least)


def united(pairs: Iterable[tuple[object, object]]) -> dict[object, object]:
    """One key for each group of keys that pairs connect."""
    parent: dict[object, object] = {}

    def root(k: object) -> object:
        while parent.setdefault(k, k) != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for a, b in pairs:
        parent[root(b)] = root(a)
    return {k: root(k) for k in list(parent)}


def leaked(index: Index, texts: list[str | None]) -> list[list[object]]:
    """The items that each text holds."""
    bare = [unmarked(t) if t else "" for t in texts]
    streams = [squeezed(t) for t in bare]
    found: list[set[int]] = [set() for _ in texts]
    parts: list[tuple[int, int]] = []
    pieces: list[str] = []
    for n, s in enumerate(streams):
        step = WINDOW - 2 * (index.longest + 2 * index.widest)
        for at in range(0, max(1, len(s)), max(step, 1024)):
            parts.append((n, at))
            pieces.append(s[at : at + WINDOW])
            if at + WINDOW >= len(s):
                break
    split: dict[int, tuple[list[str], np.ndarray]] = {}
    for part, item, lo, hi, low, high, whole in index.regions(pieces):
        n, at = parts[part]
        if item in found[n]:
            continue
        if n not in split:
            words = [w for w in (squeezed(w) for w in bare[n].split()) if w]
            split[n] = words, np.cumsum([len(w) for w in words])
        if index.holds(item, streams[n], *split[n], lo + at, hi + at, low + at, high + at, whole):
            found[n].add(item)
    return [sorted((index.items[i].key for i in f), key=str) for f in found]


def shared_runs(items: DataFrame, key: str, text: str) -> DataFrame:
    """(key, places): where the runs of RUN words of each item stand that SHARED or more items hold, copies counted once.

    Runs are counted by hash over all items; a run in every item is reduced map-side before it is joined back.
    To find copies, each item is compared with the first item of each shared run it holds, so a run in every item gives one pair an item.
    """
    kind = items.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for batch in batches:
            rows = []
            for k, t in zip(batch["k"], batch["t"]):
                words = stream_words(t) if t is not None else []
                rows += [(k, i, xxhash.xxh3_64_intdigest(" ".join(words[i : i + RUN])) - (1 << 63)) for i in range(len(words) - RUN + 1)]
            yield pd.DataFrame(rows, columns=["k", "place", "h"])

    named = items.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    placed = checkpoint(named.mapInPandas(run, f"k {kind}, place int, h bigint"))
    held = placed.select("h", "k").distinct()
    often = checkpoint(held.groupBy("h").agg(F.count("*").alias("n"), F.min("k").alias("first")).filter(F.col("n") >= SHARED))
    pairs = held.join(often, "h").filter(F.col("k") != F.col("first")).select("first", "k").distinct()

    def same(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.loc[[copies(stream_words(a), stream_words(b)) for a, b in zip(batch["t"], batch["u"])], ["first", "k"]]

    both = pairs.join(named.select(F.col("k").alias("first"), F.col("t")), "first").join(named.select("k", F.col("t").alias("u")), "k")
    group = united(tuple(r) for r in both.select("first", "k", "t", "u").mapInPandas(same, f"first {kind}, k {kind}").toLocalIterator())
    if group:
        grouped = items.sparkSession.createDataFrame(list(group.items()), f"k {kind}, g {kind}")
        known = held.join(often.select("h"), "h", "left_semi").join(grouped, "k", "left").select("h", F.coalesce("g", "k").alias("g"))
        often = known.distinct().groupBy("h").count().filter(F.col("count") >= SHARED)
    return placed.join(often.select("h"), "h", "left_semi").groupBy(F.col("k").alias(key)).agg(F.collect_list("place").alias("places"))


def find_leaks(documents: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str) -> DataFrame:
    """(key, item_key): each document that holds a passage of an item, with the item; one row a pair.

    Items are read in blocks of BLOCK characters and each block is held against all documents, whole texts
    of any length, without a shuffle; an item longer than that is a block of its own. Null and empty texts on either side give nothing; of items that are alike
    each is reported, however many they are. Repeated documents give repeated rows. Other columns are dropped, so theirs can't clash.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(key).alias("_k"), F.col(text).cast("string").alias("_t"))
    kinds = documents.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    arrow = {"bigint": pa.int64(), "int": pa.int32()}
    schema = f"`{key}` {kinds[0]}, `{item_key}` {kinds[1]}"
    named = items.select(F.col(item_key), F.col(item_text)).filter(F.col(item_text).isNotNull())
    few = (named.agg(F.sum(F.length(item_text))).first()[0] or 0) <= BLOCK
    # more than one block: sentences that items share are sought over all of them, not inside a block
    rows = (named.withColumn("_s", F.lit(None).cast("array<int>")) if few else named.join(shared_runs(named, item_key, item_text).withColumnRenamed("places", "_s"), item_key, "left")).toLocalIterator()
    block, shared, result, size = [], {}, None, 0

    def search(index: Index) -> DataFrame:
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, max(1, whole.num_rows), 256):
                    batch = whole.slice(at, 256)
                    keys = batch.column(0).to_pylist()
                    left, right = [], []
                    for k, found in zip(keys, leaked(shared.value, batch.column(1).to_pylist())):
                        left += [k] * len(found)
                        right += found
                    yield pa.RecordBatch.from_arrays([pa.array(left, arrow.get(kinds[0], pa.string())), pa.array(right, arrow.get(kinds[1], pa.string()))], names=[key, item_key])

        return docs.mapInArrow(run, schema)

    for row in rows:
        if block and size + len(row[item_text]) > BLOCK:
            part = search(Index(block, None if few else shared))
            result, block, shared, size = part if result is None else result.unionByName(part), [], {}, 0
        block.append((row[item_key], row[item_text]))
        shared[row[item_key]] = row["_s"] or []
        size += len(row[item_text])
    if block or result is None:
        part = search(Index(block, None if few else shared))
        result = part if result is None else result.unionByName(part)
    return result
