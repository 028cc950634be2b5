"""Byte-level BPE encoding of a corpus with a public vocabulary.

Two tiers. A minimal perfect hash over the vocabulary resolves the pre-tokens that are a
vocabulary entry as a whole; the rest are merged by a heap of pair ranks over a doubly
linked list of byte pieces, O(n log n) also for a pre-token of a million bytes. A batch
looks up its distinct pre-tokens only, all at once.

Defined results: null and empty texts give an empty list; there are no special tokens, so
their strings in a text are ordinary text; blank texts are encoded like any other.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from idsync.runtime import ship

# The pre-token pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MEMORY = 200_000  # merged pre-tokens that a worker remembers; then it starts anew

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser, seeded."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def hash_bytes(keys: list[bytes]) -> np.ndarray:
    """64-bit polynomial hashes of non-empty byte strings, all in one pass."""
    lengths = np.fromiter(map(len, keys), "int64", len(keys))
    data = np.frombuffer(b"".join(keys), "uint8").astype("uint64") + np.uint64(1)
    starts = np.cumsum(lengths) - lengths
    with np.errstate(over="ignore"):
        powers = np.multiply.accumulate(np.full(int(lengths.max()), _MULTIPLIER))
        weighted = data * powers[np.arange(len(data)) - np.repeat(starts, lengths)]
        return np.add.reduceat(weighted, starts) + lengths.astype("uint64")


class PerfectHash:
    """A minimal perfect hash: levels of bit arrays, a key sits where it is alone; its slot is the rank of its bit."""

    def __init__(self, hashes: np.ndarray, load: float = 2.0):
        if len(np.unique(hashes)) != len(hashes):
            raise ValueError("the keys' base hashes collide")
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        rest, placed, seed = hashes, 0, 1
        while len(rest):
            size = max(64, int(load * len(rest)))
            at = (_mix(rest, seed) % np.uint64(size)).astype("int64")
            alone = np.bincount(at, minlength=size) == 1
            self.levels.append((alone, placed + np.cumsum(alone) - alone))
            placed += int(alone.sum())
            rest, seed = rest[~alone[at]], seed + 1

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each hash; -1 where no level holds it. A foreign key may get any slot."""
        out, open_ = np.full(len(hashes), -1, "int64"), np.arange(len(hashes))
        for seed, (alone, rank) in enumerate(self.levels, 1):
            at = (_mix(hashes[open_], seed) % np.uint64(len(alone))).astype("int64")
            here = alone[at]
            out[open_[here]] = rank[at[here]]
            open_ = open_[~here]
        return out


class Encoder:
    """The encoder of one vocabulary file of ranks (base64 bytes, rank)."""

    def __init__(self, path: str = VOCABULARY, pattern: str = PATTERN):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.words = regex.compile(pattern)
        keys = list(self.ranks)
        hashes = hash_bytes(keys)
        self.hash = PerfectHash(hashes)
        slots = self.hash(hashes)
        self.keys: list[bytes] = [b""] * len(keys)
        self.ids = [0] * len(keys)
        for slot, key in zip(slots.tolist(), keys):
            self.keys[slot], self.ids[slot] = key, self.ranks[key]
        self.longest = max(map(len, keys))
        self.merged: dict[str, list[int]] = {}

    def merge(self, word: bytes) -> list[int]:
        """Merge the bytes of one pre-token, the lowest rank first, the leftmost among equals."""
        ranks, n = self.ranks, len(word)
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if end[i] < 0 or (j := after[i]) >= n or end[j] != stop:
                continue  # a piece of this pair has been merged since
            end[i], end[j], after[i] = stop, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := ranks.get(word[i : end[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[after[i]]))
            if (k := before[i]) >= 0 and (r := ranks.get(word[k:stop])) is not None:
                heapq.heappush(heap, (r, k, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : end[i]]])
            i = after[i]
        return out

    def lookup(self, words: list[str]) -> dict[str, list[int]]:
        """The ids of distinct pre-tokens: the perfect hash first, then the heap."""
        found: dict[str, list[int]] = {}
        coded = [w.encode() for w in words]
        short = [i for i, b in enumerate(coded) if len(b) <= self.longest]
        if short:
            slots = self.hash(hash_bytes([coded[i] for i in short])).tolist()
            for i, slot in zip(short, slots):
                if slot >= 0 and self.keys[slot] == coded[i]:
                    found[words[i]] = [self.ids[slot]]
        for w, b in zip(words, coded):
            if w not in found:
                ids = self.merged.get(w)
                if ids is None:
                    ids = self.merge(b)
                    if len(b) <= 64:
                        if len(self.merged) >= MEMORY:
                            self.merged.clear()
                        self.merged[w] = ids
                found[w] = ids
        return found

    def split(self, texts: list[str | None]) -> tuple[list[list[str]], dict[str, list[int]]]:
        """The pre-tokens of each text and the ids of the distinct ones."""
        words = [self.words.findall(t) if t else [] for t in texts]
        distinct: dict[str, None] = {}
        for w in words:
            distinct.update(dict.fromkeys(w))
        return words, self.lookup(list(distinct))

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, offsets)."""
        words, found = self.split(texts)
        out: list[int] = []
        offsets = [0]
        for w in words:
            for x in w:
                out += found[x]
            offsets.append(len(out))
        return np.array(out, "int32"), np.array(offsets, "int32")

    def count_batch(self, texts: list[str | None]) -> list[int]:
        words, found = self.split(texts)
        size = {w: len(ids) for w, ids in found.items()}
        return [sum(map(size.__getitem__, w)) for w in words]


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str = PATTERN) -> Encoder:
    return Encoder(path, pattern)


def slices(batch: pa.RecordBatch, column: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most ``most`` bytes of text each (a longer text comes alone)."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(size)
    if batch.num_rows > start or not batch.num_rows:
        yield batch.slice(start)


def encode(df: DataFrame, key: str, text: str, path: str = VOCABULARY, out: str = "ids") -> DataFrame:
    """(key, out): the token ids of each row's text."""
    ship(df.sparkSession)
    base = df.select(key, text)
    schema = f"`{key}` {base.schema[key].dataType.simpleString()}, `{out}` array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        enc = encoder(path)
        for whole in batches:
            for b in slices(whole, text):
                ids, offsets = enc.encode_batch(b.column(1).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))
                yield pa.RecordBatch.from_arrays([b.column(0), lists], names=[key, out])

    return base.mapInArrow(run, schema)


def token_counts(df: DataFrame, key: str, text: str, path: str = VOCABULARY, out: str = "tokens") -> DataFrame:
    """(key, out): the number of tokens of each row's text."""
    ship(df.sparkSession)
    base = df.select(key, text)
    schema = f"`{key}` {base.schema[key].dataType.simpleString()}, `{out}` int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        enc = encoder(path)
        for whole in batches:
            for b in slices(whole, text):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(enc.count_batch(b.column(1).to_pylist()), pa.int32())], names=[key, out])

    return base.mapInArrow(run, schema)
