"""Spelling variants: words at distance one, by Levenshtein automata walked through trie shards.

The words of a corpus are counted, sorted into ranges and written as compact tries of bounded size: three
flat arrays a shard, in the shared folder. Each task reads one shard after the other and walks it depth
first with the automaton of every word of its own, so that words meet whatever their lengths and
letters, without candidates by key. Words are Latin-1 inside: a byte a code point, in code-point order.
"""

from __future__ import annotations

import io
import math
import zlib
from collections import Counter, OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seepkit.llm.staging import delete, discard, file_system, materialize, new_path

#: Code points and occurrences of a word, at least; how much more frequent a form is than its variant.
LENGTH, OCCURRENCES, RATIO = 6, 5, 5
#: One run in ``HARMED`` of a document and spelling loses a code point.
HARMED = 199
#: Words of a trie shard, at most; shards that a worker holds; words that a task walks a shard with.
SHARD, HELD, WALKERS = 100_000, 2, 50_000
#: Distinct words that a task counts before it hands them on.
COUNTED = 400_000
#: Letters of a run (A-Z, a-z, U+00C0 to U+00FF), lower-cased from A to Z; everything else is a space.
LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0xC0 else 0x20 for b in range(256))


def runs(text: str) -> list[bytes]:
    """Maximal runs of letters, lower-cased, in Latin-1; characters beyond it end a run."""
    return text.encode("latin-1", "replace").translate(LETTERS).split()


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """word (binary, Latin-1) and n over all texts: runs of letters after the damage that the crc32 of
    ``key:run`` orders, of at least ``LENGTH`` code points. A null key is empty in that, null texts have no
    words. Words are counted by task before they are shuffled."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def batch_of(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crc, counts = zlib.crc32, Counter()
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = [w for w in runs(t.as_py() or "") if len(w) >= LENGTH]  # a shorter one gets no longer
                counts.update(found)
                start = crc(f"{'' if k is None else k}:".encode())
                for w in set(found):
                    h = crc(w if w.isascii() else w.decode("latin-1").encode(), start)
                    if h % HARMED == 0:
                        times, at = found.count(w), h % len(w)
                        counts[w] -= times
                        if len(w) > LENGTH:
                            counts[w[:at] + w[at + 1 :]] += times
                if len(counts) >= COUNTED:
                    yield batch_of(counts)
                    counts = Counter()
        if counts:
            yield batch_of(counts)

    return docs.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Trie:
    """A compact trie of sorted words: nodes by breadth, so that a node's children lie together.

    ``labels``: a byte a node; ``first``: where a node's children begin (they end where the next node's
    do); ``place``: the word that ends at a node, or -1. ``words`` and ``n`` by place.
    """

    def __init__(self, words: list[bytes], n: list[int]):
        self.words, self.n = words, n
        labels, first, place = bytearray(1), [], []
        spans = [(0, len(words))]
        depth = 0
        while spans:  # one level of the trie
            below = []
            for lo, hi in spans:
                ends = lo < hi and len(words[lo]) == depth
                place.append(lo if ends else -1)
                first.append(len(labels))
                lo += ends
                while lo < hi:
                    byte, at = words[lo][depth], lo
                    while at < hi and words[at][depth] == byte:
                        at += 1
                    labels.append(byte)
                    below.append((lo, at))
                    lo = at
            spans, depth = below, depth + 1
        self.labels, self.first, self.place = bytes(labels), [*first, len(labels)], place

    def write(self, path: str) -> None:
        out = io.BytesIO()
        flat = np.frombuffer(b"".join(self.words), np.uint8)
        np.savez(out, labels=np.frombuffer(self.labels, np.uint8), first=np.asarray(self.first, np.uint32), place=np.asarray(self.place, np.int32), flat=flat, ends=np.cumsum([0, *map(len, self.words)]), n=np.asarray(self.n, np.int64))
        fs, inner = file_system(path)
        with fs.open_output_stream(inner) as f:
            f.write(out.getbuffer())

    @classmethod
    def read(cls, path: str) -> Trie:
        fs, inner = file_system(path)
        with fs.open_input_file(inner) as f:
            a = np.load(io.BytesIO(f.read()))
        out = cls.__new__(cls)
        raw, ends = a["flat"].tobytes(), a["ends"].tolist()
        out.labels, out.first, out.place, out.n = a["labels"].tobytes(), a["first"].tolist(), a["place"].tolist(), a["n"].tolist()
        out.words = [raw[i:j] for i, j in zip(ends, ends[1:], strict=False)]
        return out

    def near(self, word: bytes) -> list[int]:
        """Places of the words at distance exactly one, by a depth-first walk with the word's automaton.

        A state is how much of the word is read without an edit (-1: an edit is needed) and the places in it
        that one edit can have led to. While no edit is spent every child can be next; afterwards only
        those that a place asks for.
        """
        labels, first, place, size = self.labels, self.first, self.place, len(word)
        found = []
        stack = [(0, 0, (1,))]  # one deleted letter leads to place 1
        while stack:
            node, exact, edited = stack.pop()
            if place[node] >= 0 and size in edited:
                found.append(place[node])
            lo, hi = first[node], first[node + 1]
            if lo == hi:
                continue
            if exact < 0:
                if len(edited) == 1:
                    p = edited[0]
                    if p < size and (child := labels.find(word[p], lo, hi)) >= 0:
                        stack.append((child, -1, (p + 1,)))
                    continue
                for letter in {word[p] for p in edited if p < size}:
                    if (child := labels.find(letter, lo, hi)) >= 0:
                        stack.append((child, -1, tuple({p + 1 for p in edited if p < size and word[p] == letter})))
                continue
            own = word[exact] if exact < size else -1
            for child in range(lo, hi):
                letter = labels[child]
                to = {p + 1 for p in edited if p < size and word[p] == letter}
                to.add(exact)  # the letter is inserted
                if letter == own:
                    if exact + 1 < size:
                        to.add(exact + 2)  # the next one is deleted
                    stack.append((child, exact + 1, tuple(to)))
                else:
                    if exact < size:
                        to.add(exact + 1)  # replaced
                    stack.append((child, -1, tuple(to)))
        return found


_TRIES: OrderedDict[str, Trie] = OrderedDict()


def _trie(path: str) -> Trie:
    if path not in _TRIES:
        while len(_TRIES) >= HELD:
            _TRIES.popitem(last=False)
        _TRIES[path] = Trie.read(path)
    _TRIES.move_to_end(path)
    return _TRIES[path]


def write_shards(words: DataFrame, folder: str) -> list[str]:
    """Tries of ranges of words, each of at most ``SHARD``; returns their files, in order. A task names its
    files by its attempt, and only those that a finished task reports are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held, n, paths = TaskContext.get(), [], [], []

        def close() -> None:
            paths.append(f"{folder}/{task.partitionId():06d}-{len(paths):06d}.{task.taskAttemptId()}")
            Trie(held, n).write(paths[-1])

        for batch in batches:
            held += batch.column(0).to_pylist()
            n += batch.column(1).to_pylist()
            while len(held) >= SHARD:
                rest = held[SHARD:], n[SHARD:]
                del held[SHARD:], n[SHARD:]
                close()
                held, n = rest
        if held:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], ["path"])

    fs, inner = file_system(folder)
    fs.create_dir(inner, recursive=True)
    dealt = words.select("word", "n").repartitionByRange("word").sortWithinPartitions("word")
    return sorted(r.path for r in dealt.mapInArrow(run, "path string").collect())


def neighbours(words: DataFrame, shards: list[str]) -> DataFrame:
    """word, n, n_near, form and form_n for every word against all shards: the number of words at distance
    one, and the most frequent of them (ties: least in code-point order), if there are ``RATIO`` times as
    many of it."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64()), ("n_near", pa.int64()), ("form", pa.binary()), ("form_n", pa.int64())])

    def walk(some: list[bytes], n: list[int]) -> pa.RecordBatch:
        near, best = [0] * len(some), [(0, b"")] * len(some)
        for path in shards:
            trie = _trie(path)
            for i, word in enumerate(some):
                found = trie.near(word)
                if found:
                    near[i] += len(found)
                    most = min((-trie.n[p], trie.words[p]) for p in found)
                    best[i] = min(best[i], most)
        kept = [b if -b[0] >= RATIO * k else (None, None) for b, k in zip(best, n, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(some, pa.binary()), pa.array(n, pa.int64()), pa.array(near, pa.int64()), pa.array([b for _, b in kept], pa.binary()), pa.array([b and -b for b, _ in kept], pa.int64())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], []
        for batch in batches:
            held += batch.column(0).to_pylist()
            n += batch.column(1).to_pylist()
            if len(held) >= WALKERS:
                yield walk(held, n)
                held, n = [], []
        if held:
            yield walk(held, n)

    return words.select("word", "n").mapInArrow(run, "word binary, n long, n_near long, form binary, form_n long")


def roots(found: DataFrame, most: int) -> DataFrame:
    """word and root of the words that have a form: forms followed to the last. Every step multiplies n by
    ``RATIO`` at least, so the longest way follows from the largest count ``most``; each round doubles how
    far a word looks."""
    links = materialize(found.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "links")
    far = int(math.log(max(most / OCCURRENCES, 1), RATIO) + 1e-9)
    for _ in range(math.ceil(math.log2(far)) if far > 1 else 0):
        on = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = materialize(links.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "links")
        discard(links)
        links = further
    return links


def spelling_variants(docs: DataFrame) -> DataFrame:
    """Every word of at least ``LENGTH`` code points and ``OCCURRENCES`` with its form: word, form, root, n,
    n_near, form_n.

    Null and empty texts have no words, a null doc_id counts as an empty one in the damage, rows that
    repeat count each, ties of n go to the word that is least in code-point order, words of any length
    are walked whole, other columns are ignored; without words the result is empty. It is a table in the
    shared folder.
    """
    spark = docs.sparkSession
    words = materialize(word_counts(docs).filter(f"n >= {OCCURRENCES}"), "words")
    folder = new_path(spark, "tries")
    shards = write_shards(words, folder)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-words.count() // WALKERS))
    found = materialize(neighbours(words.repartition(parts, "word"), shards), "neighbours")
    delete(spark, folder)
    linked = roots(found, found.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0])
    word, form, root = (F.decode(c, "ISO-8859-1").alias(c) for c in ("word", "form", "root"))
    joined = found.join(linked, "word", "left").withColumn("root", F.coalesce("root", "word"))
    out = materialize(joined.select(word, form, root, "n", "n_near", "form_n"), "variants")
    discard(words, found, linked)
    return out
