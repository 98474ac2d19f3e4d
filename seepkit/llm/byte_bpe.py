"""Byte-level BPE, encoding and decoding, in two tiers.

Tier one is a minimal perfect hash (hash and displace) over the vocabulary: a pre-token that is a
vocabulary entry gets its id with one probe and one comparison. Tier two, for the others, merges a
doubly linked list of bytes with a heap of (rank, place), so a pre-token of n bytes costs
O(n log n) even when it is a megabyte of one letter.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seepkit.llm.chunks import TwoGenerations, encode_texts

_CODERS: dict = {}
#: Pre-tokens whose ids a worker remembers, and the longest.
REMEMBERED, LONGEST = 200_000, 48


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PerfectHash:
    """Minimal perfect hash of byte strings: every key has a slot of its own among len(keys)."""

    def __init__(self, keys: list[bytes], load: int = 2):
        n = self.n = max(1, len(keys))
        self.buckets = max(1, n // load)
        groups: list[list[int]] = [[] for _ in range(self.buckets)]
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        for i, h in enumerate(hashes):
            groups[h % self.buckets].append(i)
        self.shift = [0] * self.buckets
        self.slots = [-1] * n
        order = sorted(range(self.buckets), key=lambda b: -len(groups[b]))
        for b in order:
            if len(groups[b]) < 2:
                break
            d, at = 0, []
            while len(set(at)) < len(groups[b]) or any(self.slots[x] >= 0 for x in at):
                at = [self.place(hashes[i], d) for i in groups[b]]
                d += 1
            self.shift[b] = d - 1
            for i, x in zip(groups[b], at, strict=True):
                self.slots[x] = i
        free = iter([x for x, i in enumerate(self.slots) if i < 0])
        for b in order:  # a bucket of one key names its slot
            if len(groups[b]) == 1:
                x = next(free)
                self.shift[b], self.slots[x] = -1 - x, groups[b][0]

    def place(self, h: int, d: int) -> int:
        h = ((h >> 17) + d * 0x9E3779B97F4A7C15 ^ h * (2 * d + 1)) & 0xFFFFFFFFFFFFFFFF
        h = (h ^ h >> 31) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
        return (h ^ h >> 29) % self.n

    def slot(self, key: bytes) -> int:
        """The only place where the key can be."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.buckets]
        return self.slots[-1 - d if d < 0 else self.place(h, d)]


class ByteBPE:
    """Encodes as greedy lowest-rank merging does; decodes by table."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.keys = list(ranks)
        self.ids = [ranks[k] for k in self.keys]
        self.whole = PerfectHash(self.keys)
        self.find = regex.compile(pattern).findall
        self.table = {i: k for k, i in ranks.items()}
        self.digits = {i: str(i) for i in self.table}
        self.byte = [ranks[bytes([b])] for b in range(256)]
        # a merge joins two entries whose bytes together are an entry: rank of the pair of ids
        self.merge: dict[int, int] = {}
        for k, i in ranks.items():
            for cut in range(1, len(k)):
                a, b = ranks.get(k[:cut]), ranks.get(k[cut:])
                if a is not None and b is not None:
                    self.merge[a << 32 | b] = i
        self.known: dict[str, bytes] = {}
        self.cache = TwoGenerations(self._missing)

    def pre_token(self, piece: bytes) -> list[int]:
        i = self.whole.slot(piece)
        return [self.ids[i]] if i >= 0 and self.keys[i] == piece else self.by_heap(piece)

    def by_heap(self, piece: bytes) -> list[int]:
        ids = [self.byte[b] for b in piece]
        n, merge = len(ids), self.merge
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []
        for i in range(n - 1):
            r = merge.get(ids[i] << 32 | ids[i + 1])
            if r is not None:
                heap.append((r, i))
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            r, i = pop(heap)
            j = right[i]
            if ids[i] < 0 or j >= n or merge.get(ids[i] << 32 | ids[j]) != r:
                continue  # one of the two was merged meanwhile
            ids[i], ids[j] = r, -1
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                if (r2 := merge.get(r << 32 | ids[k])) is not None:
                    push(heap, (r2, i))
            if (h := left[i]) >= 0 and (r2 := merge.get(ids[h] << 32 | r)) is not None:
                push(heap, (r2, h))
        return [x for x in ids if x >= 0]

    def text(self, text: str) -> bytes:
        """Ids of a text, each match of the pattern by itself."""
        out, known = [], self.known
        for piece in self.find(text):
            got = known.get(piece)
            if got is None:
                got = np.asarray(self.pre_token(piece.encode("utf-8", "replace")), "<u4").tobytes()
                if len(piece) <= LONGEST:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[piece] = got
            out.append(got)
        return b"".join(out)

    def _missing(self, pieces: list[str]) -> list[bytes]:
        line = self.text("\n")  # put before a text or between its lines; always a match of its own
        return [line + self.text(x[1:]) if x[:1] == "\n" else self.text(x if x[0] == " " else " " + x) if x else b"" for x in pieces]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        return [ids[a + 1 : b] for _, _, ids, at in encode_texts(texts, "bytes", self.cache) for a, b in zip(at, at[1:], strict=False)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.table.__getitem__, ids))


def coder(path: str, pattern: str) -> ByteBPE:
    if (path, pattern) not in _CODERS:
        _CODERS[path, pattern] = ByteBPE(read_ranks(path), pattern)
    return _CODERS[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and ``ids`` (array of int) of every whole text; null and empty texts have no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = coder(path, pattern).encode(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))], [key, "ids"])

    return docs.select(key, F.col(text).cast("string")).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, ids array<int>")


def decode_documents(tokens: DataFrame, path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key and ``bytes`` of each row's ids; null ids are no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [coder(path, pattern).decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], [key, "bytes"])

    return tokens.select(key, ids).mapInArrow(run, f"{key} {tokens.schema[key].dataType.simpleString()}, bytes binary")


def bpe_digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: a round trip through ids, digested in place.

    Every row gets a row: null and empty texts have no ids and the digests of nothing, repeated rows
    repeat, other columns are ignored. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = coder(path, pattern)
            n, of_ids, of_bytes = [], [], []
            for ids in c.encode(batch.column(1)):
                ids = ids.tolist()
                n.append(len(ids))
                of_ids.append(hashlib.sha256(" ".join(map(c.digits.__getitem__, ids)).encode()).hexdigest())
                of_bytes.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids), pa.array(of_bytes)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
