"""Exact Jaccard join of shingle sets, and the components of its links.

Sets with the same digest are one *class*. Classes are joined with token-combination prefixes:

* Tokens are ordered rarest first (by exact document frequency, then hash). Of a set of n tokens at
  most tau = n - ceil(t n) lack in any partner, so a prefix that an adversary can't break by
  removing tau tokens shares a signature with every partner.
* Frequency splits tokens in classes: rare tokens are indexed one by one, tokens of class k (those in
  more than ``OFTEN[k - 2]`` sets) by combinations of k. The prefix is extended until its cover exceeds
  tau. All combinations of a class would grow with a power of the set, so a class is dealt to groups by
  hash and only tokens of one group are combined: of m tokens in a group the first k - 1 give no cover,
  each further one does. The number of groups follows from the sizes at hand (``Level``), for sets of
  every size, such that the cover is always enough.
* A pair meets at the level (power of two) of its larger set, where both ends know the groups.
* Frequencies are needed for the tokens with a hash below a level's limit only. ``SHARES`` names the
  sampled share by set size; both ends of a pair have all their tokens below the limit, so the argument
  holds within the sample as it stands. A set whose sample happens not to hold the cover it needs makes
  its level *weak*: the sets that meet partners at weak levels, and no others, are indexed there again
  with all their tokens. So no pair depends on chance.
* A set with more than tau unique tokens has no partner and drops out there.

Candidates are pairs that share a signature. To compare them, sets are gathered by *family*: the sets
that chains of signatures join. A family of few sets is one task's item, in which pairs that share a
signature are compared exactly; pairs already in one component aren't. A large family is dealt to blocks
of ``ROWS`` sets at most: first ``HEADS`` of its sets meet all blocks, and what they join is a component;
then only the sets outside the largest component meet all blocks. Tasks return at most a link per set,
and components of the links are the result.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seepkit.llm.names import named, unused
from seepkit.llm.staging import discard, materialize
from seepkit.llm.words import grams, mix, slices, word_hashes
from seepkit.llm.workers import tidy
from seepkit.operators.connectivity import components

WORDS, PERCENT = 5, 80
#: (least set size, share of hashes that are sampled), falling.
SHARES = ((0, 1.0), (256, 0.5), (1024, 0.4), (2048, 0.35), (4096, 0.3))
FULL = ((0, 1.0),)
#: Frequencies from which 2, 3, ... tokens are combined.
OFTEN = (64,)
#: Bits of a filter of hashes: a power of two near 8 a value, at most 2^27 (16 MB).
MOST_BITS = 27
#: Sets and tokens in a block of a family, and sets of a large family that meet all of it first.
ROWS, BLOCK, HEADS = 256, 400_000, 32


def shingles(h: np.ndarray, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``words`` words; fewer words are one run."""
    if not len(h):
        return h
    if len(h) < words:
        return mix(grams(h, len(h)) + np.uint64(len(h)))
    return np.unique(grams(h, words))


def tau(n: int, percent: int = PERCENT) -> int:
    """Most tokens of a set of n that a partner can lack: its overlap is at least percent * n."""
    return n - -(-percent * n // 100)


def limit(s: float) -> np.int64:
    """Hashes below it, read as signed, are the share s."""
    return np.int64(min(2**63 - 1, int(-(2**63) + s * 2**64)))


class Level:
    """Level x: pairs whose larger set has 2^x to 2^(x + 1) - 1 tokens.

    groups[k]: groups of the tokens that are combined by k. A group costs its first k - 1 tokens' cover;
    the least set that meets partners here, with a sample five deviations below its mean, can spare half
    of what it holds beyond tau + 1. With all tokens sampled this is no matter of chance. Where the least
    sets can spare nothing for a class (0 groups), its tokens count to the class below.
    """

    def __init__(self, x: int, shares: tuple, percent: int, classes: int):
        least = max(1, -(-percent * 2**x // 100))
        self.share = next(s for n, s in reversed(shares) if 2**x >= n)
        self.limit = limit(self.share)
        held = least * self.share - 5 * (least * self.share * (1 - self.share)) ** 0.5
        spare = max(0, int(held) - tau(least, percent) - 1) // (2 if self.share == 1 and least > 8 else 1)
        self.groups = {k: spare // (classes - 1) // (k - 1) for k in range(2, classes + 1)}


@cache
def level(x: int, shares: tuple, percent: int, classes: int) -> Level:
    return Level(x, shares, percent, classes)


def levels(n: int, percent: int = PERCENT) -> range:
    """Levels at which a set of n meets partners of other tokens: those of the larger set. None if any
    other set lacks too much."""
    most = n * 100 // percent
    return range(n.bit_length() - 1, most.bit_length()) if most > n or tau(n, percent) else range(0)


ROWS_OF = ["uid", "id", "x", "n", "d1", "d2", "tokens", "counts"]


def _sampled(shares: tuple, percent: int, classes: int, only: frozenset | None = None):
    """A number, id, text's key, size, digest of each row's set; for one row of a class in a task, one with an id,
    its tokens below its own level's limit and their numbers at each of its levels. ``only``: levels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        uid = TaskContext.get().partitionId() << 33
        for batch in batches:
            for lo, hi in slices(batch.column(2)):
                some = batch.slice(lo, hi - lo)
                h, at = word_hashes(some.column(2), lower=True)
                n, d1, d2, lists, counts = [], [], [], [], []
                known = some.column(0).is_valid().to_pylist()
                for i in range(len(some)):
                    s = shingles(h[at[i] : at[i + 1]]).view(np.int64)
                    digest = _digest(s)
                    n.append(len(s))
                    d1.append(digest[0])
                    d2.append(digest[1])
                    mine = [x for x in levels(len(s), percent) if only is None or x in only]
                    if not known[i] or not mine or digest in seen:
                        lists.append(None)
                        counts.append(None)
                        continue
                    seen.add(digest)
                    below = [s if (v := level(x, shares, percent, classes)).share == 1 else s[s < v.limit] for x in mine]
                    lists.append(max(below, key=len))
                    counts.append([len(x) for x in below])
                ids = pa.array(np.arange(uid, uid + len(some)), pa.int64())
                uid += len(some)
                yield pa.RecordBatch.from_arrays([ids, some.column(0), some.column(1), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(lists, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int64()))], ROWS_OF)

    return run


def _digest(s: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def signatures(df: np.ndarray, h: np.ndarray, need: int, count: int, x: int, groups: dict[int, int], often: tuple) -> np.ndarray | None:
    """Signatures of a set at level x. df, h: its repeated tokens in the sample; count: all its tokens
    there. None if they don't give the cover; empty if it has no partner."""
    cover = count - len(h)  # unique tokens come first and match nothing
    if cover >= need:
        return np.zeros(0, np.int64)
    order = np.lexsort((h, df))
    df, h = df[order], h[order]
    spread = mix(h.view(np.uint64) ^ np.uint64(0x5EED))
    k = np.ones(len(h), np.int64)
    group = np.zeros(len(h), np.int64)
    for size, least in enumerate(often, 2):
        mine = df > least if groups[size] else np.zeros(len(df), bool)
        k[mine] = size
        group[mine] = (spread[mine] % np.uint64(max(1, groups[size]))).astype(np.int64)
    taken: dict[tuple[int, int], list[int]] = {}
    for token, *place in zip(h.tolist(), k.tolist(), group.tolist(), strict=True):
        held = taken.setdefault(tuple(place), [])
        held.append(token)
        cover += len(held) >= place[0]
        if cover >= need:
            break
    else:
        return None
    made = []
    for size in {s for s, _ in taken}:
        combos = [c for (s, _), held in taken.items() if s == size for c in (zip(held) if size == 1 else itertools.combinations(sorted(held), size))]
        if combos:
            table = np.asarray(combos, np.int64).view(np.uint64)
            s = np.full(len(table), size, np.uint64)
            for c in range(size):
                s = mix(s * np.uint64(3) + table[:, c])
            made.append(s)
    return np.unique(mix(np.concatenate(made) + np.uint64(x * 7919))).view(np.int64)


def _signed(shares: tuple, percent: int, often: tuple, only: frozenset | None = None):
    """uid, level, signature; a set that lacks cover gives a null signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at, signs = [], [], []
            for i, n, counts, found in zip(*(batch.column(c).to_pylist() for c in ("uid", "n", "counts", "found")), strict=True):
                h = np.asarray([x["h"] for x in found], np.int64)
                df = np.asarray([x["df"] for x in found], np.int64)
                mine = [x for x in levels(n, percent) if only is None or x in only]
                for x, count in zip(mine, counts, strict=True):
                    v = level(x, shares, percent, 1 + len(often))
                    below = h < v.limit if v.share < 1 else np.ones(len(h), bool)
                    made = signatures(df[below], h[below], tau(n, percent) + 1, count, x, v.groups, often)
                    made = [None] if made is None else made.tolist()
                    ids += [i] * len(made)
                    at += [x] * len(made)
                    signs += made
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(at, pa.int32()), pa.array(signs, pa.int64())], ["uid", "level", "s"])

    return run


def _flat(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """Codes of what occurs in two lists or more, offsets by list, and the number of codes."""
    flat = np.concatenate(lists) if lists else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    _, code, many = np.unique(flat, return_inverse=True, return_counts=True)
    keep = many[code] > 1
    return code[keep], np.searchsorted(owner[keep], np.arange(len(lists) + 1)), len(many)


class _Common:
    """How many values a list has in common with each of the lists in a range."""

    def __init__(self, lists: list[np.ndarray]):
        self.code, self.at, n = _flat(lists)
        self.mark = np.zeros(n, bool)

    def counts(self, x: int, lo: int, hi: int) -> np.ndarray:
        mine = self.code[self.at[x] : self.at[x + 1]]
        self.mark[mine] = True
        sums = np.concatenate([[0], np.cumsum(self.mark[self.code[self.at[lo] : self.at[hi]]])])
        self.mark[mine] = False
        return np.diff(sums[self.at[lo : hi + 1] - self.at[lo]])


def verify(ids: list[int], sets: list[np.ndarray], marks: list[np.ndarray], sides: list[bool], roots: list[int] | None = None, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links that join what is linked among the candidates: pairs that share a mark (a signature), across
    the two sides if both occur. Pairs that links, or equal ``roots``, have joined already aren't compared."""
    m = len(sets)
    n = np.asarray([len(s) for s in sets], np.int64)
    order = np.argsort(n, kind="stable")  # partners are near in size
    n = n[order]
    tokens, shared = _Common([sets[i] for i in order]), _Common([marks[i] for i in order])
    name = np.asarray(ids, np.int64)[order]
    side = np.asarray(sides, bool)[order]
    two = side.any() and not side.all()
    root, links = np.unique(np.asarray(ids if roots is None else roots, np.int64)[order], return_inverse=True)[1], []
    for x in range(m):
        last = int(np.searchsorted(n, n[x] * 100 // percent, "right"))
        later = slice(x + 1, last)
        if last <= x + 1:
            continue
        open_ = (root[later] != root[x]) & (name[later] != name[x])
        if two:
            open_ &= side[later] != side[x]
        if open_.any():
            open_ &= shared.counts(x, x + 1, last) > 0
        if not open_.any():
            continue
        common = tokens.counts(x, x + 1, last)
        for j in x + 1 + np.flatnonzero(open_ & (100 * common >= percent * (n[x] + n[later] - common))):
            if root[x] != root[j]:
                links.append((int(name[x]), int(name[j])))
                root[root == max(root[x], root[j])] = min(root[x], root[j])
    return links


class Filter:
    """A broadcast bitmap of fixed largest size that tells most values that a column of longs lacks."""

    def __init__(self, df: DataFrame, column: str):
        self.bits = 1 << min(MOST_BITS, max(16, int(8 * df.count()).bit_length()))
        slot = F.col(column).bitwiseAND(self.bits - 1) + 1  # Spark counts bits and buckets from 1
        parts = df.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bitmap")).collect()
        bitmap = np.zeros(self.bits // 8, np.uint8)
        for r in parts:
            part = np.frombuffer(bytes(r["bitmap"]), np.uint8)
            at = (r["bucket"] - 1) * len(part)
            bitmap[at : at + len(part)] = part
        self.shared = df.sparkSession.sparkContext.broadcast(bitmap)

    def may_have(self, values: np.ndarray) -> np.ndarray:
        slots = values & (self.bits - 1)
        return (self.shared.value[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1


def _likely(known: Filter):
    """uid and the tokens that the filter may have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            h = lists.flatten().to_numpy()
            hit = known.may_have(h)
            each = np.repeat(batch.column(0).to_numpy(), np.diff(np.asarray(lists.offsets)))
            yield pa.RecordBatch.from_arrays([pa.array(each[hit]), pa.array(h[hit])], ["uid", "h"])

    return run


def _sets(wanted: Filter):
    """Digest and whole set of the rows with ids that the filter may have, once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            hit = wanted.may_have(batch.column(0).fill_null(0).to_numpy()) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array(hit))
            for lo, hi in slices(batch.column(1)):
                h, at = word_hashes(batch.column(1).slice(lo, hi - lo), lower=True)
                made = {}
                for a, b in zip(at, at[1:], strict=False):
                    s = shingles(h[a:b]).view(np.int64)
                    if (d := _digest(s)) not in seen:
                        seen.add(d)
                        made[d] = s
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in made], pa.int64()), pa.array([d for _, d in made], pa.int64()), pa.array(list(made.values()), pa.list_(pa.int64()))], ["d1", "d2", "tokens"])

    return run


def _arrays(column: pa.ChunkedArray) -> list[np.ndarray]:
    lists = column.combine_chunks()
    values, at = lists.values.to_numpy(), np.asarray(lists.offsets)
    return [values[a:b] for a, b in zip(at, at[1:], strict=False)]


class Classes:
    """``rows`` (uid, id, x, n, d1, d2, stands; one a row of the table, x a hash of the text) and ``labels``
    (d1, d2, comp) of all classes with an id: the least id that links reach."""

    def __init__(self, docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, shares: tuple = SHARES):
        t = F.coalesce(named(text).cast("string"), F.lit(""))
        self.source = docs.select(named(key).cast("long").alias("id"), F.xxhash64(t).alias("x"), t.alias("t"))
        self.percent = percent
        rows = self._read(shares)
        owner = materialize(self._owner(rows), "owners")
        signed = self._index(rows, owner, shares)
        whole, stands = rows, F.col("counts").isNotNull().alias("stands")
        rows = self.rows = materialize(rows.select("uid", "id", "x", "n", "d1", "d2", stands), "sizes")
        discard(whole)  # the tokens are the largest of the tables
        weak = frozenset(r["level"] for r in signed.filter("s is null").select("level").distinct().collect())  # at most one a level
        usable = signed.filter("s is not null").select("uid", "s", "level")
        again = []
        if weak:
            full = self._read(FULL, weak)
            theirs = materialize(self._owner(full), "owners-again")
            more = self._index(full, theirs, FULL, weak)
            same = theirs.withColumnRenamed("uid", "other").join(owner, ["d1", "d2"]).select("other", "uid")
            more_usable = more.withColumnRenamed("uid", "other").join(same, "other").select("uid", "s", "level")
            usable = usable.filter(~F.col("level").isin(*weak)).union(more_usable)
            again = [full, theirs, more]
        first = usable.groupBy("s").agg(F.min("uid").alias("pivot"), F.count("*").alias("c")).filter("c > 1").select("s", "pivot")
        first = materialize(first, "pivots")  # so that the join's sides are plain exchanges, which can be split
        shared = materialize(usable.join(first, "s").select("uid", "s", "pivot"), "shared")
        discard(signed, first, *again)
        families = components(shared.filter("uid <> pivot").select("uid", "pivot").distinct(), "uid", "pivot").select(F.col("node").alias("uid"), F.col("comp").alias("family"))
        marks = shared.groupBy("uid").agg(F.collect_list("s").alias("marks"))
        wanted = rows.filter("stands").select("uid", "id", "n", "d1", "d2").join(families, "uid").join(marks, "uid")
        wanted = materialize(wanted, "wanted")
        sets = self.source.select("id", "t").mapInArrow(tidy(_sets(Filter(wanted, "id"))), "d1 long, d2 long, tokens array<long>")
        members = materialize(sets.join(wanted.drop("id"), ["d1", "d2"]).drop("d1", "d2").dropDuplicates(["uid"]), "members")
        discard(shared, wanted)
        links, used = self._links(members)
        joined = owner.join(components(links, "a", "b").select(F.col("node").alias("uid"), F.col("comp").alias("root")), "uid").select("d1", "d2", "root")
        joined = materialize(joined, "joined")
        least = materialize(rows.filter("n > 0 and id is not null").groupBy("d1", "d2").agg(F.min("id").alias("least")), "least")
        roots = joined.join(least, ["d1", "d2"]).groupBy("root").agg(F.min("least").alias("top"))
        linked = joined.join(roots, "root").select("d1", "d2", "top")
        self.labels = least.join(linked, ["d1", "d2"], "left").select("d1", "d2", F.coalesce("top", "least").alias("comp"))
        discard(owner, members, *used)

    def _read(self, shares: tuple, only: frozenset | None = None) -> DataFrame:
        schema = "uid long, id long, x long, n long, d1 long, d2 long, tokens array<long>, counts array<long>"
        return materialize(self.source.mapInArrow(tidy(_sampled(shares, self.percent, 1 + len(OFTEN), only)), schema), "sets")

    @staticmethod
    def _owner(rows: DataFrame) -> DataFrame:
        """The row that stands for each class."""
        return rows.filter("counts is not null").groupBy("d1", "d2").agg(F.min("uid").alias("uid"))

    def _index(self, rows: DataFrame, owner: DataFrame, shares: tuple, only: frozenset | None = None) -> DataFrame:
        """(uid, level, s): the signatures of each class, null where a sample was too small."""
        tokens = rows.filter("tokens is not null")
        repeated = materialize(tokens.select(F.explode("tokens").alias("h")).groupBy("h").agg(F.count("*").alias("df")).filter("df > 1"), "frequencies")
        likely = tokens.select("uid", "tokens").mapInArrow(tidy(_likely(Filter(repeated, "h"))), "uid long, h long")
        found = likely.join(repeated, "h").groupBy("uid").agg(F.collect_list(F.struct("df", "h")).alias("found"))
        counted = rows.filter("counts is not null").select("uid", "n", "counts").join(owner.select("uid"), "uid")
        ready = counted.join(found, "uid", "left").withColumn("found", F.coalesce("found", F.array().cast("array<struct<df:bigint,h:bigint>>")))
        signed = materialize(ready.select("uid", "n", "counts", "found").mapInArrow(tidy(_signed(shares, self.percent, OFTEN, only)), "uid long, level int, s long"), "signatures")
        discard(repeated)
        return signed

    def _compared(self, items: DataFrame) -> DataFrame:
        """Links (a, b) within each item (family, b, l) of uid, root, tokens, marks and side."""
        percent = self.percent

        def run(table: pa.Table) -> pa.Table:
            found = verify(table["uid"].to_pylist(), _arrays(table["tokens"]), _arrays(table["marks"]), table["side"].to_pylist(), table["root"].to_pylist(), percent)
            return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

        columns = ["family", "b", "l", "uid", "root", "tokens", "marks", "side"]
        return materialize(items.select(*columns).groupBy("family", "b", "l").applyInArrow(run, "a long, b long"), "links")

    def _links(self, members: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
        """(a, b): links that join each component, and the tables to discard."""
        zero, yes, no = F.lit(0).cast("long"), F.lit(True), F.lit(False)

        def blocks(name: str):
            return F.greatest(F.ceil(F.count("*") / ROWS), F.ceil(F.sum("n") / BLOCK)).cast("long").alias(name)

        size = materialize(members.groupBy("family").agg(blocks("blocks")), "families")
        sized = members.withColumn("root", F.col("uid")).join(size, "family")
        small = self._compared(sized.filter("blocks = 1").withColumns({"b": zero, "l": zero, "side": no}))
        if size.filter("blocks > 1").isEmpty():
            return small, [size, small]
        large = sized.filter("blocks > 1").withColumns({"b": F.pmod(F.xxhash64("uid"), F.col("blocks")), "l": zero})
        place = F.row_number().over(Window.partitionBy("family").orderBy(F.xxhash64("uid", F.lit(1)), "uid"))
        heads = materialize(large.select("family", "uid").withColumn("r", place).filter(F.col("r") <= HEADS).select("uid"), "heads")
        all_blocks = F.explode(F.sequence(zero, F.col("blocks") - 1))
        ahead = large.join(heads, "uid").withColumns({"b": all_blocks, "side": yes})
        some = self._compared(large.withColumn("side", no).unionByName(ahead))
        # what the heads joined; the sets outside each family's largest component meet all its others
        joined = components(some, "a", "b").select(F.col("node").alias("uid"), F.col("comp").alias("other"))
        roots = materialize(large.select("family", "uid", "n").join(joined, "uid", "left").select("family", "uid", "n", F.coalesce("other", "uid").alias("root")), "roots")
        largest = roots.groupBy("family", "root").agg(F.count("*").alias("c")).groupBy("family").agg(F.max_by("root", F.struct("c", "root")).alias("largest"))
        left = materialize(roots.join(largest, "family").filter("root <> largest").join(heads, "uid", "left_anti").select("family", "uid", "n"), "left")
        parts = left.groupBy("family").agg(blocks("parts"))
        rooted = large.drop("root", "l", "b").join(roots.select("uid", "root"), "uid").join(parts, "family")
        these = rooted.withColumns({"b": F.pmod(F.xxhash64("uid"), F.col("blocks")), "l": F.explode(F.sequence(zero, F.col("parts") - 1)), "side": no})
        those = rooted.join(left.select("uid"), "uid").withColumns({"b": all_blocks, "l": F.pmod(F.xxhash64("uid", F.lit(2)), F.col("parts")), "side": yes})
        rest = self._compared(these.unionByName(those))
        return small.union(some).union(rest), [size, small, heads, some, roots, left, rest]


def _labelled(docs: DataFrame, key: str, text: str, percent: int) -> DataFrame:
    """id, x (hash of the text), n and comp of every row."""
    found = Classes(docs, key, text, percent)
    rows = found.rows.join(found.labels, ["d1", "d2"], "left")
    return rows.select("id", "x", "n", F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("comp")).otherwise(F.col("id")).alias("comp"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row.

    Null and empty texts have no shingles, are linked with nothing and are their own component;
    rows with equal sets, repeated rows too, share a component; rows that repeat an id with other texts
    are judged each by its text; a null id keeps a null n_shingles-only row of its own and takes no part;
    other columns are ignored; an empty table gives no rows.
    """
    return _labelled(docs, key, text, percent).select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that have the least id of their component, once each; all columns.

    Rows that repeat an id and a text are one; rows with a null id take no part and stay; null and empty
    texts stay; columns may have any names; an empty table stays empty.
    """
    i, x = unused(docs, "i", "x")
    best = _labelled(docs, key, text, percent).filter("id = comp").select(F.col("id").alias(i), F.col("x").alias(x)).distinct()
    keyed = docs.withColumns({i: named(key).cast("long"), x: F.xxhash64(F.coalesce(named(text).cast("string"), F.lit("")))})
    kept = keyed.join(best, [i, x]).dropDuplicates([i, x]).select(*(named(c) for c in docs.columns))
    return kept.union(docs.filter(named(key).isNull()))
