"""Substring deduplication by relative Lempel-Ziv parsing over an index of windows.

A window is ``WINDOW`` consecutive words. Every distinct text is a reference block. The index holds the
windows that occur at two places or more, each once, at its *source*: the least block that has it and the
first place there. So the windows of the index form reference passages without repetition, and a window
leads to one place in them at most.

A text is parsed greedily: from the first word that opens a window of the index, the *factor* is the
longest match of the text with the source's block - it grows as long as the next word's window has the
source that follows in the same block. Parsing goes on behind the factor. A factor has at least a
window's length. Windows that begin in a factor and end behind it are looked up too (``crossing``): a
window over the end of a factor may be repeated though no factor holds it. Factors and crossing windows
are the duplicate spans.

Only windows that can repeat are looked up. Winnowing picks in each window the place of the least
hash of ``ANCHOR`` words; equal windows pick equal anchors, so a window whose anchor occurs once
occurs once. Anchors are about a fifteenth of the words. Steps, each written to the shared folder:

1. texts -> word counts, digests and anchors; equal texts count as one block with a multiplicity;
2. anchors that occur twice (aggregate with map-side combining, then a join that can be split);
3. texts of blocks with such anchors -> fingerprints of the windows that pick them;
4. fingerprints that occur twice, with their sources: the index -> parse of each block -> spans of words;
5. spans, by digest, to every row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seepkit.llm.names import named, unused
from seepkit.llm.staging import discard, materialize
from seepkit.llm.words import grams, long_grams, slices, word_hashes
from seepkit.llm.workers import tidy

WINDOW, ANCHOR = 35, 8
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
NOTHING = hashlib.sha256(b"").hexdigest()


def winnow(h: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """(place of each window's anchor, anchor hashes by place); ties go to the rightmost."""
    g = grams(h, anchor)
    span = window - anchor + 1
    n = len(h) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), g
    # least of each run of `span` hashes, by doubling; the low bits name the place within the run
    best, place, width = g.copy(), np.arange(len(g)), 1
    while width < span:
        step = min(width, span - width)
        a, b = best[:-step], best[step:]
        right = b <= a
        best, place = np.where(right, b, a), np.where(right, place[step:], place[:-step])
        width += step
    return place[:n], g


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, text and two hashes that stand for the text."""
    t = F.coalesce(named(text).cast("string"), F.lit(""))
    return docs.select(named(key).cast("long").alias("__id"), t.alias("__t"), F.xxhash64(t).alias("k1"), F.xxhash64(F.lit(11), t).alias("k2"))


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts, digest of all words and anchors; texts seen before in the task carry no anchors."""
    seen: set = set()
    for batch in batches:
        for lo, hi in slices(batch.column(1)):
            some = batch.slice(lo, hi - lo)
            h, at = word_hashes(some.column(1))
            keys = list(zip(some.column(2).to_pylist(), some.column(3).to_pylist(), strict=True))
            n, sha, lists, carries = [], [], [], []
            for i, (k, t) in enumerate(zip(keys, some.column(1).cast(pa.binary()).to_pylist(), strict=True)):
                words = h[at[i] : at[i + 1]]
                n.append(len(words))
                sha.append(hashlib.sha256(b" ".join(t.split())).hexdigest())
                carries.append(k not in seen)
                seen.add(k)
                if carries[-1] and len(words) >= WINDOW:
                    place, g = winnow(words)
                    lists.append(g[np.unique(place)].view(np.int64))
                else:
                    lists.append(None)
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), some.column(3), pa.array(n, pa.int64()), pa.array(sha), pa.array(carries), pa.array(lists, pa.list_(pa.int64()))], ["id", "k1", "k2", "n", "sha", "carries", "anchors"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """uid, place, first place with the same fingerprint in the text, and fingerprint of the windows that
    pick a repeated anchor."""
    for batch in batches:
        for lo, hi in slices(batch.column(1), 1_000_000):
            some = batch.slice(lo, hi - lo)
            h, at = word_hashes(some.column(1))
            uid, place, first, prints = [], [], [], []
            for i, (u, picked) in enumerate(zip(some.column(0).to_pylist(), some.column(2).to_pylist(), strict=True)):
                words = h[at[i] : at[i + 1]]
                where, _ = winnow(words)
                hit = np.unique(where)[np.asarray(picked)]
                starts = np.flatnonzero(np.isin(where, hit))
                place.append(starts)
                mine = long_grams(words, WINDOW)[starts]
                _, at_first, code = np.unique(mine, return_index=True, return_inverse=True)
                first.append(starts[at_first[code]])
                prints.append(mine)
                uid.append(np.full(len(starts), u))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(uid)), pa.array(np.concatenate(place).astype(np.int32)), pa.array(np.concatenate(first).astype(np.int32)), pa.array(np.concatenate(prints).view(np.int64))], ["uid", "p", "first", "w"])


def factors(starts: np.ndarray, blocks: np.ndarray, places: np.ndarray, window: int = WINDOW) -> list[tuple[int, int, int, int]]:
    """(first word, words, block, place in it) of the greedy parse. ``starts``, ascending: where windows of
    the index begin in the text; ``blocks`` and ``places``: their sources."""
    follows = (np.diff(starts) == 1) & (np.diff(blocks) == 0) & (np.diff(places) == 1)
    last = np.append(np.flatnonzero(~follows), len(starts) - 1)  # of the windows that one source continues
    out, i = [], 0
    while i < len(starts):
        j = last[np.searchsorted(last, i)]
        out.append((int(starts[i]), int(starts[j] - starts[i]) + window, int(blocks[i]), int(places[i])))
        i = int(np.searchsorted(starts, starts[j] + window))
    return out


def crossing(starts: np.ndarray, made: list[tuple[int, int, int, int]], window: int = WINDOW) -> list[tuple[int, int]]:
    """(start, end) of the words of windows in the index that begin in a factor and end behind it."""
    out = []
    for a, n, _, _ in made:
        i, j = np.searchsorted(starts, (a + n - window + 1, a + n))
        if i < j:  # less than a window apart, they leave no gap
            out.append((int(starts[i]), int(starts[j - 1]) + window))
    return out


def covered(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of (start, end) spans in ascending order."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = [], []
        lists = batch.column(1)
        at = np.asarray(lists.offsets)
        flat = lists.values.flatten()
        p, block, place = (x.to_numpy() for x in flat)
        for lo, hi in zip(at, at[1:], strict=False):
            order = lo + np.argsort(p[lo:hi], kind="stable")
            made = factors(p[order], block[order], place[order])
            merged = covered([(s, s + n) for s, n, _, _ in made] + crossing(p[order], made))
            a.append([x for x, _ in merged])
            b.append([x for _, x in merged])
        kind = pa.list_(pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(a, kind), pa.array(b, kind)], ["uid", "a", "b"])


class Duplicates:
    """Spans of duplicate words by text: ``rows`` (id, k1, k2, n, sha, cnt, a, b; one a row of the
    table) and ``texts`` (uid, text of blocks with candidates)."""

    def __init__(self, docs: DataFrame, key: str = "doc_id", text: str = "text"):
        source = keyed(docs, key, text)
        self.seen = materialize(source.select("__id", "__t", "k1", "k2").mapInArrow(tidy(_anchored), "id long, k1 long, k2 long, n long, sha string, carries boolean, anchors array<long>"), "anchors")
        least = F.lit(-(1 << 63)).cast("long")
        carriers = self.seen.filter("carries").groupBy("k1", "k2").agg(F.min(F.coalesce("id", least)).alias("rep"))
        counts = self.seen.groupBy("k1", "k2").agg(F.count("*").alias("cnt"))
        self.blocks = materialize(counts.join(carriers, ["k1", "k2"]).withColumn("uid", F.monotonically_increasing_id()), "blocks")
        owned = self.seen.filter("anchors is not null").select("k1", "k2", F.coalesce("id", least).alias("rep"), "anchors")
        owned = owned.join(self.blocks.select("k1", "k2", "rep", "uid"), ["k1", "k2", "rep"]).dropDuplicates(["uid"])
        places = owned.select("uid", F.posexplode("anchors").alias("i", "g"))
        # written apart, so that both sides of the join are plain exchanges, which Spark can split where a
        # frequent passage makes one long
        twice = materialize(places.groupBy("g").agg(F.count("*").alias("c")).filter("c > 1").select("g"), "repeated-anchors")
        hits = places.join(twice, "g").groupBy("uid").agg(F.sort_array(F.collect_set("i")).alias("picked"))
        hits = materialize(hits.join(self.blocks.select("uid", "k1", "k2", "rep"), "uid"), "hits")
        mine = source.select("__t", "k1", "k2", F.coalesce("__id", least).alias("rep"))
        self.texts = materialize(mine.join(hits, ["k1", "k2", "rep"]).select("uid", "__t", "picked").dropDuplicates(["uid"]), "texts")
        windows = materialize(self.texts.mapInArrow(tidy(_windows), "uid long, p int, first int, w long"), "windows")
        index = windows.groupBy("w").agg(F.count("*").alias("c"), F.min("uid").alias("block"), F.min_by("first", "uid").alias("place"))
        index = materialize(index.filter("c > 1").select("w", "block", "place"), "index")
        found = windows.select("uid", "p", "w").join(index, "w").groupBy("uid").agg(F.collect_list(F.struct("p", "block", "place")).alias("found"))
        self.spans = materialize(found.mapInArrow(tidy(_spans), "uid long, a array<int>, b array<int>"), "spans")
        discard(twice, hits, windows, index)

    def partial(self) -> DataFrame:
        """uid, text and spans of the blocks that lose some words and are no copies."""
        single = self.blocks.filter("cnt = 1").select("uid")
        return self.texts.select("uid", "__t").join(self.spans.join(single, "uid"), "uid")


def kept_words(text: bytes, a: list[int], b: list[int]) -> bytes:
    words = text.split()
    for x, y in zip(reversed(a), reversed(b), strict=True):
        del words[x:y]
    return b" ".join(words)


def kept_text(text: bytes, a: list[int], b: list[int]) -> bytes:
    """The text without the spans' words; what stays keeps its own spacing, a newline at each cut."""
    at = [m.span() for m in _WORD.finditer(text)]
    out, word = [], 0
    for x, y in [*zip(a, b, strict=True), (len(at), len(at))]:
        if x > word:
            out.append(text[at[word][0] : at[x - 1][1]])
        word = y
    return b"\n".join(out)


def substring_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row.

    Null and empty texts have no words and the digest of nothing; rows with equal texts, repeated
    rows too, lose all words if they have a window's length; other columns are ignored.
    """
    found = Duplicates(docs)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            sha = [hashlib.sha256(kept_words(t, x, y)).hexdigest() for t, x, y in zip(batch.column("__t").cast(pa.binary()).to_pylist(), a, b, strict=True)]
            gone = [sum(y) - sum(x) for x, y in zip(a, b, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("uid"), pa.array(gone, pa.int64()), pa.array(sha)], ["uid", "gone", "kept"])

    cut = found.partial().mapInArrow(tidy(digest), "uid long, gone long, kept string")
    by_text = found.blocks.join(cut, "uid", "left").select("k1", "k2", "cnt", "gone", "kept")
    rows = found.seen.select("id", "k1", "k2", "n", "sha").join(by_text, ["k1", "k2"])
    whole = (F.col("cnt") > 1) & (F.col("n") >= WINDOW)
    return rows.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_words"),
        F.when(whole, F.col("n")).otherwise(F.coalesce("gone", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, NOTHING).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )


def without_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with duplicate spans cut from the text; every row stays.

    What is kept keeps its own spacing, with a newline at each cut. Texts without duplicates, null
    and empty ones too, stay as they are; rows with equal texts lose all words if they have a window's
    length; a null id counts like any other; other columns, whatever their names, are passed on; an empty
    table stays empty.
    """
    found = Duplicates(docs, key, text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column("__t").cast(pa.binary()).to_pylist(), batch.column("a").to_pylist(), batch.column("b").to_pylist())
            made = [kept_text(t, a, b).decode() for t, a, b in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("uid"), pa.array(made, pa.string())], ["uid", "new"])

    texts = found.partial().mapInArrow(tidy(cut), "uid long, new string")
    long = found.seen.filter((F.col("n") >= WINDOW) & F.col("carries")).select("k1", "k2").distinct()
    whole = found.blocks.filter("cnt > 1").join(long, ["k1", "k2"], "left_semi").select("k1", "k2", F.lit("").alias("new"))
    k1, k2, new = unused(docs, "k1", "k2", "new")
    changed = found.blocks.join(texts, "uid").select("k1", "k2", "new").union(whole).toDF(k1, k2, new)
    t = F.coalesce(named(text).cast("string"), F.lit(""))
    rows = docs.withColumns({k1: F.xxhash64(t), k2: F.xxhash64(F.lit(11), t)}).join(changed, [k1, k2], "left")
    return rows.select(*(F.coalesce(F.col(new), named(c)).alias(c) if c == text else named(c).alias(c) for c in docs.columns))
