"""Encoding of a whole corpus with a public byte-level BPE vocabulary.

Text is cut into pre-tokens by the vocabulary's pattern; each pre-token's bytes
are merged in the order of merge ranks. The pending merges wait in a rank
queue: one bucket of linked-list positions per rank, and a hierarchical bitmap
over the ranks whose find-first-set gives the next one. Entries whose pair has
changed since they were queued are skipped. A pre-token of n bytes costs O(n)
queue operations, so long unbroken runs do not degrade to O(n^2).

The vocabulary file is read once on the driver, its size is checked, and its
bytes are broadcast (under 1 MB); executors need no file.

Null and empty texts encode to an empty list; names of special tokens in a
text are ordinary text.
"""

from __future__ import annotations

import base64
import os
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the public vocabularies lie unless a path is given.
VOCABULARIES = os.environ.get("LODEWEAVE_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MAX_VOCABULARY_BYTES = 32 << 20
#: Pre-tokens up to this many characters are remembered; at most so many of them.
CACHED_LENGTH, CACHED = 32, 1 << 18


class RankQueue:
    """Priority queue over small integers: buckets under a hierarchical bitmap.

    Level 0 has one bit per rank, each higher level one bit per word below;
    the lowest set bit of each level's word leads to the smallest queued rank.
    """

    def __init__(self, ranks: int) -> None:
        self.levels: list[list[int]] = []
        size = ranks
        while True:
            size = (size + 63) // 64
            self.levels.append([0] * size)
            if size == 1:
                break
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(position)
            return
        self.buckets[rank] = [position]
        at = rank
        for level in self.levels:
            word, bit = at >> 6, 1 << (at & 63)
            if level[word] & bit:
                break
            level[word] |= bit
            at = word

    def pop(self) -> tuple[int, list[int]] | None:
        """The smallest rank and its positions, or None when empty."""
        if not self.levels[-1][0]:
            return None
        at = 0
        for level in reversed(self.levels):
            word = level[at]
            at = (at << 6) | ((word & -word).bit_length() - 1)
        rank, child = at, at
        for level in self.levels:
            word = child >> 6
            level[word] &= ~(1 << (child & 63))
            if level[word]:
                break
            child = word
        return rank, self.buckets.pop(rank)


class Encoder:
    """Byte-level BPE over ``ranks`` (token bytes -> id)."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.pattern = regex.compile(PATTERN)
        self.queue = RankQueue(max(ranks.values(), default=0) + 1)
        self.cache: dict[str, tuple[int, ...]] = {}

    def merge(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        n, get, queue = len(data), self.ranks.get, self.queue
        end = list(range(1, n + 1))  # end[i] is where the part that starts at i ends; 0 if i starts none
        before = list(range(-1, n))  # start of the part before the one that starts at i
        pending = [-1] * n  # rank of the pair that starts at i, as last queued
        for i in range(n - 1):
            rank = get(data[i : i + 2])
            if rank is not None:
                pending[i] = rank
                queue.push(rank, i)
        while (popped := queue.pop()) is not None:
            rank, positions = popped
            if len(positions) > 1:
                positions.sort()
            for i in positions:
                if pending[i] != rank or not end[i]:
                    continue
                middle = end[i]
                stop = end[middle]
                end[i], end[middle] = stop, 0
                pending[middle] = -1
                if stop < n:
                    before[stop] = i
                    new = get(data[i : end[stop]])
                    pending[i] = -1 if new is None else new
                    if new is not None:
                        queue.push(new, i)
                else:
                    pending[i] = -1
                left = before[i]
                if left >= 0:
                    new = get(data[left:stop])
                    pending[left] = -1 if new is None else new
                    if new is not None:
                        queue.push(new, left)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[data[i : end[i]]])
            i = end[i]
        return out

    def encode_into(self, text: str, out: array) -> None:
        cache = self.cache
        for piece in self.pattern.findall(text):
            ids = cache.get(piece)
            if ids is None:
                ids = tuple(self.merge(piece.encode("utf-8", "replace")))
                if len(piece) <= CACHED_LENGTH:
                    if len(cache) >= CACHED:
                        cache.clear()
                    cache[piece] = ids
            out.extend(ids)

    def encode(self, text: str) -> list[int]:
        out = array("i")
        self.encode_into(text, out)
        return out.tolist()


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes -> id of a rank file: one base64 token and its id a line."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


@lru_cache(maxsize=4)
def _encoder(data: bytes) -> Encoder:
    return Encoder(parse_ranks(data))


def _vocabulary(spark: SparkSession, path: str):
    data = open(path, "rb").read()
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path}: {len(data)} bytes are too many to broadcast")
    return spark.sparkContext.broadcast(data)


def vocabulary_path(name: str = "byte_bpe_50k") -> str:
    return os.path.join(VOCABULARIES, f"{name}.tiktoken")


def token_ids(spark: SparkSession, text: Column | str, path: str | None = None) -> Column:
    """array<int> of the ids of ``text``; empty for null and empty texts."""
    vocabulary = _vocabulary(spark, path or vocabulary_path())

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encode(texts: pa.Array) -> pa.Array:
        encoder, out = _encoder(vocabulary.value), array("i")
        offsets = array("i", [0])
        for value in texts:
            value = value.as_py()
            if value:
                encoder.encode_into(value, out)
            offsets.append(len(out))
        return pa.ListArray.from_arrays(pa.array(np.frombuffer(offsets, dtype=np.int32)), pa.array(np.frombuffer(out, dtype=np.int32) if out else np.empty(0, np.int32)))

    return encode(text)


def token_count(spark: SparkSession, text: Column | str, path: str | None = None) -> Column:
    """Number of ids of ``text``; 0 for null and empty texts."""
    vocabulary = _vocabulary(spark, path or vocabulary_path())

    @F.arrow_udf(T.LongType())
    def count(texts: pa.Array) -> pa.Array:
        encoder, sizes = _encoder(vocabulary.value), []
        for value in texts:
            value, out = value.as_py(), array("i")
            if value:
                encoder.encode_into(value, out)
            sizes.append(len(out))
        return pa.array(sizes, pa.int64())

    return count(text)
