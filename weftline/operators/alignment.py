"""Translations that belong to another sentence: anchors written in one row but found in a neighbour's source."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.state import numbered

_SPAN = re.compile(r"`([^`\n]+)`|(https?://[^\s`)>\]]+)|\$([^$\n]+)\$")
_WORD = re.compile(r"[A-Za-z0-9]+(?:-[A-Za-z0-9]+)*")
# Number words that a translation may write in digits.
NUMBERS = {w: str(i) for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve".split())}


def _fold(word: str) -> str:
    word = word.lower().lstrip("0") or "0"
    return word[:-1] if len(word) > 3 and word.endswith("s") and not word.endswith("ss") else word


def written_anchors(text: str) -> set[str]:
    """Code, addresses, formulas, Latin words of two letters or more and numbers, as written."""
    found = {f"`{m[1]}" if m[1] else m[2].lower() if m[2] else f"${m[3]}" for m in _SPAN.finditer(text)}
    for m in _WORD.finditer(_SPAN.sub(" ", text)):
        if len(m[0]) >= 2 or m[0].isdigit():
            found.add(_fold(m[0].replace("-", "")))
    return found


def source_anchors(text: str) -> set[str]:
    """A generous reading of a source: what is written, words of code and compounds apart, number words in digits."""
    found = written_anchors(text)
    for m in _WORD.finditer(text):
        found.add(_fold(m[0]))
        found |= {_fold(p) for p in m[0].split("-")}
        found.add("`" + m[0])
        if m[0].lower() in NUMBERS:
            found.add(NUMBERS[m[0].lower()])
    return found


def is_strong(anchor: str) -> bool:
    """Code of more than two characters, a formula of more than one, an address, or letters with digits."""
    if anchor.startswith("`"):
        return len(anchor) > 3
    if anchor.startswith("$"):
        return len(anchor) > 2
    return "://" in anchor or bool(re.search(r"[a-z]", anchor) and re.search(r"\d", anchor))


def restates_a_name(shared: set[str], translation: str) -> bool:
    """Whether the anchors are capitalised words and short ones of one phrase in Latin letters: a translation may name what its source left implicit, which is no content from elsewhere."""
    names = {_fold(w.replace("-", "")) for w in re.findall(r"(?<![\w`])[A-Z][A-Za-z0-9]*(?:-[A-Za-z0-9]+)*", translation)}
    if not all(a in names or (len(a) <= 3 and a.isascii() and a.isalpha()) for a in shared):
        return False
    return any(shared <= written_anchors(run) for run in re.findall(r"[\x00-\x7f]+", translation))


def misaligned(rows: list[tuple[str | None, str | None]]) -> dict[int, tuple[int, list[str]]]:
    """Rows whose translation holds anchors foreign to its own source and found in another's, with that row and the anchors: one strong anchor or two others are evidence; of several rows the last with most anchors counts."""
    read = [(source_anchors(s or ""), written_anchors(t or "")) for s, t in rows]
    return {i: hit for i in range(len(rows)) if (hit := _moved(rows, read, i, range(len(rows))))}


def _moved(rows: list[tuple[str | None, str | None]], read: list[tuple[set[str], set[str]]], i: int, among: range) -> tuple[int, list[str]] | None:
    """The row among `among` whose source row i renders, with the anchors that tell; read holds each row's source and written anchors."""
    if rows[i][0] is None or rows[i][1] is None:
        return None
    foreign = read[i][1] - read[i][0]
    best: tuple[int, int] | None = None
    for j in among if foreign else ():
        shared = foreign & read[j][0] if j != i else set()
        # anchors that the other row still writes itself were not moved
        if shared and (any(map(is_strong, shared)) or len(shared) >= 2) and not shared <= read[j][1] and not restates_a_name(shared, rows[i][1]) and (best is None or len(shared) >= best[0]):
            best = len(shared), j
    return (best[1], sorted(foreign & read[best[1]][0])) if best else None


#: Rows of one chunk of a file; neighbours in other chunks are copied to it.
CHUNK = 20_000


def misaligned_in_sequence(rows: DataFrame, file: str, order: str, source: str, translation: str, radius: int = 3, chunk: int = CHUNK) -> DataFrame:
    """(file, order, offset, anchors): rows that render a neighbour within `radius` places of the document. Each row meets at most 2 * radius others; null texts are skipped.

    Files are cut into chunks of `chunk` rows, at least `radius`, so that a large one is no hot group; the rows at a chunk's edges are copied to the chunk beside it.
    """
    chunk = max(chunk, radius)
    kinds = rows.schema[file].dataType.simpleString(), rows.schema[order].dataType.simpleString()
    named = rows.select(F.col(file).alias("file"), F.col(order).alias("at"), F.col(source).alias("s"), F.col(translation).alias("t"))
    placed = numbered(named, "file", ["at"], "i").withColumn("own", F.floor(F.col("i") / F.lit(chunk)).cast("bigint"))
    inside = F.col("i") - F.col("own") * chunk
    also = F.array_compact(F.array(F.col("own"), F.when((inside < radius) & (F.col("own") > 0), F.col("own") - 1), F.when(inside >= chunk - radius, F.col("own") + 1)))

    def found(part: pd.DataFrame) -> list[tuple]:
        places, pairs = part["at"].tolist(), list(zip(part["s"], part["t"]))
        read = [(source_anchors(s or ""), written_anchors(t or "")) if s is not None or t is not None else (set(), set()) for s, t in pairs]
        out = []
        for k, (own, c) in enumerate(zip(part["own"], part["c"])):
            hit = _moved(pairs, read, k, range(max(0, k - radius), min(len(pairs), k + radius + 1))) if own == c else None
            if hit:
                out.append((part["file"].iloc[0], places[k], hit[0] - k, hit[1]))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Chunks come one after the other, each in order; the last of a batch may go on in the next."""
        rest = None
        for batch in batches:
            part = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            # null files compare as one
            key = part["file"].astype(object).where(part["file"].notna(), None).map(repr) + "/" + part["c"].astype(str)
            cut = np.flatnonzero(np.r_[True, key.to_numpy()[1:] != key.to_numpy()[:-1]])
            rest = part.iloc[cut[-1] :]
            rows = [r for a, b in zip(cut, cut[1:]) for r in found(part.iloc[a:b])]
            yield pd.DataFrame(rows, columns=["file", "at", "offset", "anchors"])
        if rest is not None and len(rest):
            yield pd.DataFrame(found(rest), columns=["file", "at", "offset", "anchors"])

    chunks = placed.withColumn("c", F.explode(also)).repartition("file", "c").sortWithinPartitions("file", "c", "i")
    return chunks.mapInPandas(run, f"file {kinds[0]}, at {kinds[1]}, offset int, anchors array<string>")
