"""Pattern packing: documents into sequences of a fixed length by non-negative least squares.

1. Each document's length (with its end id) is cut into pieces: all of the full length but the
   first, which holds the remainder. Pieces are written once, without text.
2. The histogram of piece lengths (at most ``capacity`` rows, whatever the corpus) goes to the driver.
3. Patterns are all multisets of one to three lengths that sum to the capacity. Repeat counts x >= 0
   minimise |A x - histogram|^2 (A sparse: three entries a column) by accelerated projected
   gradients, are rounded down, and what remains is packed longest first into the fullest space that
   holds it - histogram against histogram, so the cost depends on the capacity and not on the corpus.
4. A piece's rank among those of its length (partition base by prefix sum + place in its partition)
   picks its slot in the plan, which gives sequence and offset. No group of equal lengths is ever
   gathered in one task.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seepkit.llm.staging import materialize
from seepkit.llm.tokens import encoder
from seepkit.llm.workers import tidy

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: one if it fits, else full ones after the remainder."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first), *((a, capacity) for a in range(first, n, capacity))]


def cuts(n: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, piece, start, length) of the pieces of documents of n tokens, as ``cut`` has them."""
    first = np.where(n <= capacity, n, np.where(n % capacity, n % capacity, capacity))
    many = 1 + (n - first) // capacity
    who = np.repeat(np.arange(len(n)), many)
    piece = np.arange(len(who)) - np.repeat(np.cumsum(many) - many, many)
    start = np.where(piece > 0, first[who] + (piece - 1) * capacity, 0)
    return who, piece, start, np.where(piece > 0, capacity, first[who])


def ranks(length: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Place of each piece among those of its length, after the ``seen[n]`` of length n before; adds to ``seen``."""
    order = np.argsort(length, kind="stable")
    ordered = length[order]
    opens = np.flatnonzero(np.diff(ordered, prepend=-1))
    within = np.arange(len(ordered)) - np.repeat(opens, np.diff(np.append(opens, len(ordered))))
    rank = np.empty(len(length), np.int64)
    rank[order] = seen[ordered] + within
    seen += np.bincount(length, minlength=len(seen))
    return rank


def token_pieces(docs: DataFrame, encode_path: str, end_id: int, capacity: int, with_ids: bool = False) -> DataFrame:
    """Pieces of every whole text, with each piece's rank among those of its length in its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(capacity + 1, np.int64)
        part = TaskContext.get().partitionId()
        for batch in batches:
            for lo, hi, ids, at in encoder(encode_path, "bytes").encode_ended(batch.column(1), end_id):
                who, piece, start, length = cuts(np.diff(at), capacity)
                raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
                places = ((at[who] + start) * 4).tolist()
                parts = [raw[a : a + n] for a, n in zip(places, (length * 4).tolist(), strict=True)]
                columns = [
                    batch.column(0).slice(lo, hi - lo).take(pa.array(who)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length),
                    pa.array(list(map(zlib.crc32, parts)), pa.int64()), pa.array(np.full(len(who), part), pa.int32()), pa.array(ranks(length, seen)),
                ]
                if with_ids:
                    columns.append(pa.array(list(map(bytes, parts)), pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank", *(["ids"] if with_ids else [])]
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run, "encoders"), PIECES + ", ids binary" * with_ids)


def patterns(capacity: int) -> np.ndarray:
    """All multisets of up to three lengths with the sum ``capacity``, as rows padded with 0."""
    rows = [np.array([[capacity, 0, 0]])]
    a = np.arange((capacity + 1) // 2, capacity)
    rows.append(np.stack([a, capacity - a, 0 * a], 1))
    for a in range(1, capacity // 3 + 1):
        b = np.arange(a, (capacity - a) // 2 + 1)
        rows.append(np.stack([capacity - a - b, b, np.full_like(b, a)], 1))
    return np.concatenate(rows)


def fit(hist: np.ndarray, shapes: np.ndarray, steps: int = 200) -> np.ndarray:
    """Non-negative least squares for the patterns' repeat counts; ``hist[n]`` pieces of length n."""
    used = np.ones(len(shapes), bool)
    for c in range(shapes.shape[1]):
        used &= (shapes[:, c] == 0) | (hist[shapes[:, c]] > 0)
    x = np.zeros(len(shapes))
    if not used.any():
        return x
    shape, size = shapes[used], len(hist)
    target = hist.astype(float)
    target[0] = 0
    scale = target.max()
    target /= scale
    # weights keep the least frequent lengths from being ignored
    w = 1 / np.maximum(target, 1 / scale) ** 0.5
    w[0] = 0

    def used_lengths(v: np.ndarray) -> np.ndarray:
        return sum(np.bincount(shape[:, c], v, size) for c in range(shape.shape[1]))

    def gradient(v: np.ndarray) -> np.ndarray:
        g = w * w * (used_lengths(v) - target)
        g[0] = 0
        return sum(g[shape[:, c]] for c in range(shape.shape[1]))

    # the largest curvature, by power iteration
    v = np.ones(len(shape))
    for _ in range(20):
        g = w * w * used_lengths(v)
        g[0] = 0
        v = sum(g[shape[:, c]] for c in range(shape.shape[1]))
        top = np.linalg.norm(v)
        v /= top
    y = z = np.zeros(len(shape))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, z - gradient(z) / top)
        if np.dot(new - y, z - new) > 0:  # restart the momentum where it overshoots
            t = 1.0
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z = new + (t - 1) / t2 * (new - y)
        y, t = new, t2
    x[used] = y * scale
    return x


def plan(hist: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats): sequences that use every piece of the histogram exactly once."""
    left = np.zeros(capacity + 1, np.int64)
    for n, k in hist.items():
        left[n] = k
    out = [((capacity,), int(left[capacity]))] if left[capacity] else []
    left[capacity] = 0
    shapes = patterns(capacity)
    x = np.floor(fit(left, shapes) + 1e-6).astype(np.int64)
    for i in np.argsort(-x, kind="stable")[: int((x > 0).sum())]:
        need = Counter(int(n) for n in shapes[i] if n)
        k = min(int(x[i]), *(int(left[n]) // m for n, m in need.items()))
        if k > 0:
            out.append((tuple(int(n) for n in shapes[i] if n), k))
            for n, m in need.items():
                left[n] -= m * k
    return out + residual(left, capacity)


def residual(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, of counted pieces into counted spaces."""
    spaces: dict[int, Counter] = {}  # free room -> contents -> how many
    rooms = np.zeros(capacity + 1, np.int64)
    for n in range(capacity, 0, -1):
        k = int(left[n])
        while k:
            fits = np.flatnonzero(rooms[n:])
            if len(fits):
                room = n + int(fits[0])
                held, many = next(iter(spaces[room].items()))
                take = min(k, many)
                spaces[room][held] -= take
                if not spaces[room][held]:
                    del spaces[room][held]
                rooms[room] -= take
            else:
                each = capacity // n  # as many of this length as fit in new ones
                held, room, take = (), capacity, k // each if k >= each else 0
                if take:
                    held, room, take = (n,) * (each - 1), capacity - n * (each - 1), take
                    k -= take * (each - 1)
                else:
                    take = 1
                    held, room, k = (n,) * (k - 1), capacity - n * (k - 1), 1
            spaces.setdefault(room - n, Counter())[*held, n] += take
            rooms[room - n] += take
            k -= take
    return [(held, many) for group in spaces.values() for held, many in group.items()]


class Slots:
    """Where the r-th piece of each length goes: sequence and offset."""

    def __init__(self, made: list[tuple[tuple[int, ...], int]]):
        by_length: dict[int, list] = {}
        base = 0
        for lengths, repeats in made:
            offset, places = 0, {}
            for n in lengths:
                places.setdefault(n, []).append(offset)
                offset += n
            for n, offsets in places.items():
                for at in offsets:
                    by_length.setdefault(n, []).append((repeats, base, at))
            base += repeats
        self.sequences = base
        self.of = {}
        for n, rows in by_length.items():
            r, b, at = (np.array(c, np.int64) for c in zip(*rows, strict=True))
            self.of[n] = (np.cumsum(r) - r, b, at)

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for n in np.unique(length):
            rows = np.flatnonzero(length == n)
            first, base, at = self.of[int(n)]
            i = np.searchsorted(first, rank[rows], "right") - 1
            sequence[rows] = base[i] + rank[rows] - first[i]
            offset[rows] = at[i]
        return sequence, offset


def pack(docs: DataFrame, encode_path: str, end_id: int = 0, capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and with
    ``with_ids`` the piece's ids as little-endian unsigned 32-bit integers.

    Null and empty texts are the end id alone; repeated rows are packed each; a null doc_id stays
    null; other columns are ignored; an empty table gives no rows. The broadcast plan has a bound
    that depends on the capacity alone: at most one row a pattern in use.
    """
    spark = docs.sparkSession
    pieces = materialize(token_pieces(docs, encode_path, end_id, capacity, with_ids), "pieces")
    per_part = materialize(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    hist = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = spark.sparkContext.broadcast(Slots(plan(hist, capacity)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy() + batch.column("base").to_numpy()
            sequence, offset = slots.value.place(length, rank)
            columns = {**{n: batch.column(n) for n in kept}, "sequence_id": pa.array(sequence), "offset": pa.array(offset)}
            yield pa.RecordBatch.from_pydict(columns)

    kept = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids + ", sequence_id long, offset long"
    return pieces.join(bases, ["part", "length"]).select(*kept, "rank", "base").mapInArrow(tidy(run), schema)
