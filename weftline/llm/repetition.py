"""Repetition inside single documents, by host-level rules.

Each document is measured once: the share of its characters in second or later occurrences of
lines, of sentences, of passages (four words or more) and of phrases (two words or more). Rule failures are added up
by host (the document's source), each host's rate is shrunk towards all hosts with an empirical beta
prior, and the host's verdict is joined back to its documents. A document is reported if its passages
make up the share by themselves. Short phrases also come again by chance in sound texts, so a document that
reaches the share only with them is reported if its host is bad, and not otherwise.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import checkpoint

#: Words of the shortest passage that counts by itself, and characters of it in scripts without spaces.
PHRASE, CHARACTERS = 4, 10
#: The same of the shortest phrase, which counts at bad hosts.
SHORT, FEW = 2, 6
#: Words of so many characters are searched for repetition inside them as well.
LONG = 24
#: Share of a document's characters from which a rule fails.
LINES, SENTENCES, PASSAGES = 0.3, 0.3, 0.3
#: A host is bad if its shrunk rate is at least so many times the prior's mean, and at least this high.
TIMES, LEAST = 3.0, 0.1
#: Host tables up to so many rows are sent to every executor.
BROADCAST_ROWS = 20_000

#: A word, or one character of a script without spaces.
_TOKEN = re.compile(r"[぀-ヿ㐀-鿿]|[^\W_぀-ヿ㐀-鿿]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])|\n+")
_SPACE = re.compile(r"[\W_\d]+")


def _again(ids: np.ndarray, n: int) -> np.ndarray | None:
    """Which places lie in a second or later occurrence of a run of n ids; None if none does."""
    if len(ids) <= n:
        return None
    h = ids[: len(ids) - n + 1].copy()
    for k in range(1, n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + ids[k : len(ids) - n + 1 + k]
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return None
    covered = np.zeros(len(ids), bool)
    again = order[1:][same]
    for k in range(n):
        covered[again + k] = True
    return covered


def _inside(words: list[str]) -> list[int]:
    """Characters of each long word in second or later occurrences of CHARACTERS characters inside the long words; 0 for other words."""
    at = [k for k, w in enumerate(words) if len(w) >= LONG]
    found = [0] * len(words)
    if at:
        # a sign of its own between two words, so that no run spans them
        joined = np.concatenate([np.r_[np.frombuffer(words[k].encode("utf-32-le", "surrogatepass"), np.uint32), np.uint32(0x110000 + k)] for k in at]).astype(np.uint64)
        covered = _again(joined, CHARACTERS)
        if covered is not None:
            edge = np.cumsum([0, *(len(words[k]) + 1 for k in at)])
            for k, a, b in zip(at, edge, edge[1:]):
                found[k] = int(covered[a:b].sum())
    return found


def repeated_shares(text: str) -> tuple[float, float]:
    """Shares of the characters in second or later occurrences of a phrase of at least SHORT words and of a passage of at least PHRASE words, apart from case, punctuation, white space and numbers."""
    words = [w for w in _TOKEN.findall(text.casefold()) if not w.isdecimal()]
    spaced = text.isascii() or 2 * sum(len(w) == 1 and w >= "぀" for w in words) <= len(words)
    long = any(len(w) >= LONG for w in words)
    known = {w: k for k, w in enumerate(set(words), 1)}
    ids = np.array([known[w] for w in words], np.uint64)
    short = _again(ids, SHORT if spaced else FEW)
    # what lies in a repeated passage lies in repeated phrases
    full = None if short is None else _again(ids, PHRASE if spaced else CHARACTERS)
    inside = _inside(words) if long else None
    if short is None and not (inside and any(inside)):
        return 0.0, 0.0
    # places are looked up only where something repeats
    starts = [m.start() for m in _TOKEN.finditer(text) if not m.group().isdecimal()]
    if len(starts) != len(words):
        # folding the case split or joined words: measure the folded text, whose places are its own
        text = text.casefold()
        starts = [m.start() for m in _TOKEN.finditer(text) if not m.group().isdecimal()]
    sizes = np.diff([*starts, len(text)])

    def share(covered: np.ndarray | None) -> float:
        if covered is None:
            covered = np.zeros(len(sizes), bool)
        total = (sizes * covered).sum()
        if inside:
            total += (np.array(inside) * ~covered).sum()
        return min(1.0, float(total / len(text)))

    return share(short), share(full)


def repeated_passages(text: str) -> float:
    """The share of passages alone."""
    return repeated_shares(text)[1]


def _repeated(parts: list[str], total: int) -> float:
    seen: set[str] = set()
    again = 0
    for part in parts:
        bare = _SPACE.sub(" ", part).strip().casefold()
        if bare.count(" ") < PHRASE - 1 and bare.isascii() or len(bare) < PHRASE:
            continue
        if bare in seen:
            again += len(part)
        seen.add(bare)
    return min(1.0, again / total) if total else 0.0


def measure(text: str | None) -> tuple[float, float, float, float]:
    """(lines, sentences, passages, phrases): the repeated shares of one text; 0 for a null, empty or blank one."""
    if not text or text.isspace():
        return 0.0, 0.0, 0.0, 0.0
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    phrases, passages = repeated_shares(text)
    if not passages:
        # a repeated line or sentence of a passage's length would be a repeated passage
        return 0.0, 0.0, 0.0, phrases
    return _repeated(text.split("\n"), len(text)), _repeated(_SENTENCE.split(text), len(text)), passages, phrases


def shares(documents: DataFrame, key: str, text: str, host: str) -> DataFrame:
    """(key, host, lines, sentences, passages, phrases, failures) of every document, in one pass without a shuffle; a null host is a host of its own, named by the empty string."""
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, max(1, whole.num_rows), 1024):
                batch = whole.slice(at, 1024)
                found = [measure(t) for t in batch.column(2).to_pylist()]
                columns = [pa.array([f[i] for f in found], pa.float64()) for i in range(4)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc", "host", "lines", "sentences", "passages", "phrases"])

    named = documents.select(F.col(key).alias("doc"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.col(text).cast("string").alias("text"))
    fails = [(F.col(c) >= F.lit(least)).cast("int") for c, least in (("lines", LINES), ("sentences", SENTENCES), ("passages", PASSAGES))]
    return named.mapInArrow(run, f"doc {kind}, host string, lines double, sentences double, passages double, phrases double").withColumn("failures", sum(fails[1:], fails[0]))


def host_rates(measured: DataFrame) -> DataFrame:
    """(host, documents, failed, rate, bad): each host's rate of documents that fail a rule, shrunk with a beta prior fitted to all hosts by moments."""
    hosts = checkpoint(measured.groupBy("host").agg(F.count("*").alias("documents"), F.sum((F.col("failures") > 0).cast("bigint")).alias("failed")))
    raw = F.col("failed") / F.col("documents")
    n, docs, fails, mean, spread, inverse = hosts.agg(F.count("*"), F.sum("documents"), F.sum("failed"), F.avg(raw), F.var_samp(raw), F.avg(1 / F.col("documents"))).first()
    overall = (fails or 0) / docs if docs else 0.0
    mean = min(1 - 1e-6, max(1e-6, overall))
    # between-host variance is what the sampling of each host does not explain
    between = max(1e-9, (spread or 0.0) - mean * (1 - mean) * (inverse or 1.0))
    size = min(1e6, max(2.0, mean * (1 - mean) / between - 1))
    rate = (F.col("failed") + F.lit(size * mean)) / (F.col("documents") + F.lit(size))
    return hosts.withColumn("rate", rate).withColumn("bad", F.col("rate") >= F.lit(max(LEAST, TIMES * mean)))


def repetition(documents: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """(key, host, lines, sentences, passages, phrases, failures, host_rate, bad_host, repetitive) of every document.

    repetitive: the passages reach the share PASSAGES, or at a bad host the phrases do.

    Null, empty and blank texts have share 0. Very long texts are measured whole. Repeated rows give repeated
    rows; an empty table gives none. Other columns are dropped, so theirs can't clash.
    """
    measured = checkpoint(shares(documents, key, text, host))
    hosts = host_rates(measured)
    few = hosts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rates = hosts.select("host", F.col("rate").alias("host_rate"), F.col("bad").alias("bad_host"))
    joined = measured.join(F.broadcast(rates) if few else rates, "host").withColumnRenamed("doc", key)
    return joined.withColumn("repetitive", (F.col("passages") >= PASSAGES) | (F.col("bad_host") & (F.col("phrases") >= PASSAGES)))
