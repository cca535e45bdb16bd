"""Byte-level BPE encoding and decoding.

A pre-token that is itself an entry of the vocabulary is found by one probe of a minimal perfect hash and a comparison of
its bytes. Any other pre-token is merged: its bytes form a linked list, a heap holds the adjacent pairs by rank, and the
lowest rank is joined first, leftmost on ties. The ids equal those of a rank-based encoder without special tokens.

Edge cases: a null or empty text has no ids and decodes to no bytes; rows and columns are otherwise passed on unchanged,
repeated rows included. Bytes of a text never cross a pre-token, so texts of any length need memory for their own ids only.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillveil.llm.workers import lean

#: Pre-tokens that a task remembers; beyond this it forgets all and starts again.
REMEMBERED = 300_000
_PLACE = (1 << 40) - 1


class PerfectHash:
    """Minimal perfect hash over distinct 64-bit keys: levels of bit arrays, each holding the keys that fall alone.

    A key's number is the rank of its bit, so n keys get exactly the numbers 0 to n - 1.
    """

    def __init__(self, keys: np.ndarray, load: float = 0.5):
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        taken, seed = 0, 1
        while len(keys):
            size = max(64, int(len(keys) / load))
            slots = self._slots(keys, seed, size)
            bits = np.bincount(slots, minlength=size) == 1
            self.levels.append((seed, bits, taken + np.cumsum(bits) - bits))
            taken += int(bits.sum())
            keys = keys[~bits[slots]]
            seed += 1
            if seed > 200:
                raise ValueError("keys must be distinct")

    @staticmethod
    def _slots(keys: np.ndarray, seed: int, size: int) -> np.ndarray:
        x = keys * np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64) | 1)
        x ^= x >> np.uint64(32)
        return (x * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(20)).astype(np.int64) % size

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key; a key that was not among those given gets any number, or -1."""
        out = np.full(len(keys), -1, np.int64)
        rest = np.arange(len(keys))
        for seed, bits, rank in self.levels:
            slots = self._slots(keys[rest], seed, len(bits))
            found = bits[slots]
            out[rest[found]] = rank[slots[found]]
            rest = rest[~found]
            if not len(rest):
                break
        return out


class Vocabulary:
    """Ranks of a tiktoken-style file (base64 token, space, rank on each line) and a pre-token pattern."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        tokens = list(self.ranks)
        keys = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))
        self.hash = PerfectHash(keys)
        self.at = [b""] * len(tokens)
        for token, slot in zip(tokens, self.hash(keys).tolist(), strict=True):
            self.at[slot] = token
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        top = max(self.bytes_of, default=-1) + 1
        self.lengths = np.zeros(top, np.int64)
        self.lengths[list(self.bytes_of)] = [len(t) for t in self.bytes_of.values()]
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(top)), np.uint8)
        self.single = [self.ranks[bytes([i])] for i in range(256)]
        self.pairs: dict[int, int] = {}  # by left id << 20 | right id
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    self.pairs[a << 20 | b] = rank
        self.forget()

    def forget(self) -> None:
        """Codes of the pre-tokens met so far, and the ids of each code."""
        self.codes: dict[str, int] = {}
        self.ids = array("i")
        self.ends = array("q", [0])

    def merged(self, data: bytes) -> list[int]:
        """Ids of a pre-token by merging: a heap over linked bytes."""
        get, ids = self.pairs.get, [self.single[b] for b in data]
        n = len(ids)
        now = [-1] * n  # rank of the pair that starts here; older heap entries differ from it
        heap = []
        for i in range(n - 1):
            if (r := get(ids[i] << 20 | ids[i + 1])) is not None:
                now[i] = r
                heap.append(r << 40 | i)
        if not heap:
            return ids
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            x = heappop(heap)
            i, rank = x & _PLACE, x >> 40
            if now[i] != rank:
                continue
            j = after[i]
            after[i] = k = after[j]
            ids[i], ids[j], now[i], now[j] = rank, -1, -1, -1
            if k < n:
                before[k] = i
                if (r := get(rank << 20 | ids[k])) is not None:
                    now[i] = r
                    heappush(heap, r << 40 | i)
            if (h := before[i]) >= 0:
                if (r := get(ids[h] << 20 | rank)) is None:
                    now[h] = -1
                else:
                    now[h] = r
                    heappush(heap, r << 40 | h)
        return [x for x in ids if x >= 0]

    def learn(self, tokens: set[str]) -> None:
        """Give each pre-token a code: those in the vocabulary through the perfect hash, the rest by merging."""
        fresh = list(tokens)
        data = [t.encode() for t in fresh]
        slots = self.hash(np.fromiter(map(xxhash.xxh3_64_intdigest, data), np.uint64, len(data))).tolist()
        for token, raw, slot in zip(fresh, data, slots, strict=True):
            if slot >= 0 and self.at[slot] == raw:
                self.ids.append(self.ranks[raw])
            else:
                self.ids.extend(self.merged(raw))
            self.codes[token] = len(self.ends) - 1
            self.ends.append(len(self.ids))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and the offsets of each text's ids."""
        split = [self.pattern.findall(t) for t in texts]
        met = set(chain.from_iterable(split))
        fresh = met.difference(self.codes)
        if fresh:
            if len(self.codes) + len(fresh) > REMEMBERED:
                self.forget()
                fresh = met
            self.learn(fresh)
        counts = np.array([len(own) for own in split], np.int64)
        get = self.codes.__getitem__
        codes = np.fromiter(map(get, chain.from_iterable(split)), np.int64, int(counts.sum()))
        ends, ids = np.frombuffer(self.ends, np.int64), np.frombuffer(self.ids, np.int32) if self.ids else np.zeros(0, np.int32)
        sizes = ends[codes + 1] - ends[codes]
        done = np.concatenate(([0], np.cumsum(sizes)))
        flat = ids[np.repeat(ends[codes] - done[:-1], sizes) + np.arange(done[-1])]
        return flat, done[np.concatenate(([0], np.cumsum(counts)))]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the ids, and the offsets of each row's bytes."""
        sizes = self.lengths[ids]
        done = np.concatenate(([0], np.cumsum(sizes)))
        return self.flat[np.repeat(self.starts[ids] - done[:-1], sizes) + np.arange(done[-1])], done[offsets]


@lru_cache(2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(path, pattern)


def _slices(column: pa.Array, bytes_at_once: int = 1 << 22) -> Iterator[tuple[int, int]]:
    sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + bytes_at_once, "right")))
        yield a, b
        a = b


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df without `text`, with array<int> column `ids` (which replaces a column of that name)."""
    rest = [c for c in df.columns if c not in (text, ids)]

    def run(batches):
        own = vocabulary(path, pattern)
        for batch in batches:
            for a, b in _slices(batch.column(0)):
                flat, offsets = own.encode(batch.column(0).slice(a, b - a).fill_null("").to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[1:]), lists], names=[*rest, ids])
        own.forget()

    picked = df.select(F.col(text).cast("string").alias("\0text"), *(F.col(f"`{c}`") for c in rest))
    return picked.mapInArrow(lean(run), T.StructType([*(df.schema[c] for c in rest), T.StructField(ids, T.ArrayType(T.IntegerType()))]))


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with binary column `out`: the bytes of `ids`. Ids outside the vocabulary are an error; null counts as none."""
    rest = [c for c in df.columns if c not in (ids, out)]

    def run(batches):
        own = vocabulary(path, pattern)
        for batch in batches:
            lists = batch.column(0).fill_null([]).cast(pa.list_(pa.int32()))
            offsets = lists.offsets.to_numpy().astype(np.int64)
            values = lists.values.to_numpy(zero_copy_only=False)
            for a in range(0, len(lists), 1000):
                b = min(len(lists), a + 1000)
                data, at = own.decode(values[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                made = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(np.ascontiguousarray(at)), pa.py_buffer(data.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(c.slice(a, b - a) for c in batch.columns[1:]), made], names=[ids, *rest, out])

    picked = df.select(F.col(ids), *(F.col(f"`{c}`") for c in rest))
    return picked.mapInArrow(lean(run), T.StructType([df.schema[ids], *(df.schema[c] for c in rest), T.StructField(out, T.BinaryType())]))


def digests(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text, from the ids and the bytes that they decode to."""
    coded = decode(encode(df.select("doc_id", "text"), path, pattern), path, pattern)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
