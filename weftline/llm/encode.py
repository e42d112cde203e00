"""Encoding a corpus with a public byte-level BPE vocabulary, by forced-boundary splitting.

A byte pair that occurs inside no vocabulary token can never be joined by a merge, so every
encoding has a boundary there. Every text is cut at all its forced pairs, but for those where a cut
would change what the pre-tokenizer sees; the fragments are encoded apart and their ids put
one after the other. Most fragments come again and again, so each is encoded once a worker and
looked up after that.

Why the cuts are certain. Merges never cross a forced pair, so inside one pre-token both sides merge
as they would alone. The pre-tokenizer's pattern looks ahead only from white space and joins only white
space to what follows it, so no cut is made after white space; before white space a pre-token always ends. Inside a
run of other signs a cut before an apostrophe would let it begin a contraction, so none is made there.
Any other cut between two characters lies inside a run of letters, digits or signs, of which both parts
match the same alternative, or between two runs, where pre-tokens end anyway.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folder of the vocabulary files; a parameter of every function below.
VOCABULARY_DIR = os.environ.get("WEFTLINE_TOKENIZERS", "/opt/tokenizers")
#: The pre-tokenizer pattern of the byte_bpe vocabularies (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Characters that the pattern or Python takes for white space: no cut is made after one.
_SPACE = np.array([*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF], np.uint32)
#: Fragments up to this many characters are remembered, at most KEPT of them a worker.
SHORT, KEPT = 40, 300_000


class ForcedEncoder:
    """The encoder of one vocabulary."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.core = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.ranks = ranks
        joined = np.zeros((256, 256), dtype=bool)
        for token in ranks:
            if len(token) > 1:
                b = np.frombuffer(token, np.uint8)
                joined[b[:-1], b[1:]] = True
        self.forced = ~joined
        #: Encoded fragments, their ids as bytes.
        self._seen: dict[str, bytes] = {}

    def cuts(self, text: str) -> np.ndarray:
        """Where the text may be cut: the places of the characters that begin a fragment, without the first."""
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        if len(c) < 2:
            return np.zeros(0, np.int64)
        if text.isascii():
            ends, begins = c[:-1], c[1:]
        else:
            # last byte of each character and first byte of the next one
            a, b = c[:-1], c[1:]
            ends = np.where(a < 0x80, a, 0x80 | (a & 0x3F))
            begins = np.where(b < 0x80, b, np.where(b < 0x800, 0xC0 | (b >> 6), np.where(b < 0x10000, 0xE0 | (b >> 12), 0xF0 | (b >> 18))))
        at = np.flatnonzero(self.forced[ends, begins])
        left, right = c[at], c[at + 1]
        word = ((left >= 48) & (left <= 57)) | ((left | 32) - 97 < 26)
        return at[~np.isin(left, _SPACE) & (word | (right != 39))] + 1

    def encode(self, text: str | None) -> list[int]:
        """The ids of one text; an empty or null text gives none. Special tokens' strings are ordinary text."""
        return self.encode_many([text])[1].tolist()

    def encode_many(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each text, all ids one after the other). Texts are laid end to end and always cut where one ends."""
        seen = self._seen
        if len(seen) > KEPT:
            seen.clear()
        whole = "".join(t for t in texts if t)
        ends = np.cumsum([len(t) if t else 0 for t in texts], dtype=np.int64)
        if not whole:
            return np.zeros(len(texts), np.int64), np.zeros(0, np.int32)
        cut = np.zeros(len(whole) + 1, bool)
        cut[self.cuts(whole)] = cut[ends] = cut[0] = True
        edges = np.flatnonzero(cut)
        at = edges.tolist()
        pieces = [whole[i:j] for i, j in zip(at, at[1:])]
        found = list(map(seen.get, pieces))
        if None in found:
            for n, (p, ids) in enumerate(zip(pieces, found)):
                if ids is None:
                    ids = seen.get(p)
                    if ids is None:
                        ids = np.array(self.core.encode_ordinary(p), np.int32).tobytes()
                        if len(p) <= SHORT:
                            seen[p] = ids
                    found[n] = ids
        upto = np.r_[0, np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) // 4)]
        done = upto[np.searchsorted(edges, ends)]
        return np.diff(np.r_[0, done]), np.frombuffer(b"".join(found), np.int32)


@functools.cache
def encoder(path: str) -> ForcedEncoder:
    return ForcedEncoder(path)


def encode_column(df: DataFrame, key: str, text: str, vocabulary: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(key, ids) of every row: the text's token ids, without special tokens.

    Empty and null texts give an empty list. Texts of any length are encoded whole; repeated rows
    give repeated rows. No row moves between partitions. Other columns are dropped, so theirs can't clash.
    """
    path = os.path.join(folder or VOCABULARY_DIR, f"{vocabulary}.tiktoken")
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(path)
        for whole in batches:
            for at in range(0, max(1, whole.num_rows), 1024):
                batch = whole.slice(at, 1024)
                counts, ids = known.encode_many(batch.column(1).to_pylist())
                offsets = np.zeros(len(counts) + 1, np.int32)
                np.cumsum(counts, out=offsets[1:])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], names=[key, "ids"])

    return df.select(F.col(key), F.col(text).cast("string").alias("_text")).mapInArrow(run, schema)


def decoded(df: DataFrame, key: str, ids: str, text: str, vocabulary: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(key, same): whether the ids of every row stand for the bytes of its text; a null text stands for an empty one."""
    path = os.path.join(folder or VOCABULARY_DIR, f"{vocabulary}.tiktoken")
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("same", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        core = encoder(path).core
        for batch in batches:
            same = [core.decode_bytes(i or []) == (t or "").encode() for i, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(same, pa.bool_())], names=[key, "same"])

    return df.select(F.col(key), F.col(ids).alias("_ids"), F.col(text).cast("string").alias("_text")).mapInArrow(run, schema)
