"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first search.

Largest inner product becomes least distance when each vector x gets the coordinate
sqrt(M^2 - |x|^2) (M the largest norm) and each query a zero. A tree of k-means splits is fitted on
a sample of at most ``SAMPLE`` vectors; every vector is indexed in the leaf it descends to. A query
walks the tree through a priority queue ordered by the distance to centres and visits leaves until
it has seen as many as calibration asks for: leaf visits are doubled, then refined, until sample
queries find ``TARGET`` of their true neighbours within the sample.

Equal vectors are one point of the index with the ids that can matter (the k + 1 least). Leaves in
tree order form about ``LANES`` lanes of vectors, queries blocks of at most ``QUERY_BLOCK`` by the leaf
that they visit first; a lane meets the blocks that visit its leaves, and a task reads its vectors as a
stream, so a query returns one list of k + 1 a lane however large the table is. Lanes and blocks that
one leaf makes larger are split in parts. The tree, each leaf's lane and its block, of bounded size,
are broadcast.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seepkit.llm.staging import materialize

#: Vectors that the tree is fitted on, those that calibrate it, the share of true neighbours they
#: must find, branches of a node, rows aimed at per leaf, vectors compared at once, queries of a block
#: and lanes of vectors.
SAMPLE, CALIBRATE, TARGET, BRANCHES, LEAF, LEAF_BLOCK, QUERY_BLOCK, LANES = 20_000, 300, 0.97, 8, 200, 2_048, 8_192, 8


class Tree:
    """centres[i] of node i; children[i] a list of nodes; leaf[i] the leaf's number or -1."""

    def __init__(self, points: np.ndarray, leaf_points: int, seed: int = 7):
        self.centres: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.leaf: list[int] = []
        self.leaves = 0
        r = np.random.default_rng(seed)
        self._grow(points, leaf_points, r)
        self.stacked = [np.stack([self.centres[c] for c in kids]) if kids else None for kids in self.children]

    def _grow(self, points: np.ndarray, leaf_points: int, r) -> int:
        me = len(self.centres)
        self.centres.append(points.mean(0) if len(points) else np.zeros(points.shape[1]))
        self.children.append([])
        self.leaf.append(-1)
        groups = _kmeans(points, BRANCHES, r) if len(points) > leaf_points else []
        if len(groups) < 2:
            self.leaf[me] = self.leaves
            self.leaves += 1
        else:
            self.children[me] = [self._grow(g, leaf_points, r) for g in groups]
        return me

    def descend(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row."""
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not self.children[node]:
                out[rows] = self.leaf[node]
                continue
            pick = _distances(x[rows], self.stacked[node]).argmin(1)
            todo += [(c, rows[pick == i]) for i, c in enumerate(self.children[node]) if (pick == i).any()]
        return out

    def best_bins(self, q: np.ndarray, most: int) -> list[int]:
        """Leaves in the order of a best-bin-first walk, ``most`` at most."""
        heap, out = [(0.0, 0)], []
        while heap and len(out) < most:
            _, node = heapq.heappop(heap)
            while self.children[node]:  # down to a leaf by the nearest centres, the others wait
                d = ((self.stacked[node] - q) ** 2).sum(1)
                i = int(d.argmin())
                for j, c in enumerate(self.children[node]):
                    if j != i:
                        heapq.heappush(heap, (float(d[j]), c))
                node = self.children[node][i]
            out.append(self.leaf[node])
        return out


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (c**2).sum(1) - 2 * x @ c.T


def _kmeans(points: np.ndarray, k: int, r, rounds: int = 8) -> list[np.ndarray]:
    centres = points[r.choice(len(points), min(k, len(points)), replace=False)]
    for _ in range(rounds):
        pick = _distances(points, centres).argmin(1)
        centres = np.stack([points[pick == i].mean(0) for i in range(len(centres)) if (pick == i).any()])
    pick = _distances(points, centres).argmin(1)
    return [points[pick == i] for i in range(len(centres)) if (pick == i).any()]


def augmented(x: np.ndarray, norm: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(0, norm**2 - (x**2).sum(1)))
    return np.concatenate([x, rest[:, None]], 1)


def calibrate(tree: Tree, points: np.ndarray, queries: np.ndarray, k: int, norm: float, target: float) -> int:
    """Least leaf visits with which the queries find ``target`` of their k best points."""
    if not len(points) or not len(queries):
        return tree.leaves
    leaf = tree.descend(augmented(points, norm))
    truth = np.argsort(-(queries @ points.T), 1, kind="stable")[:, :k]
    # place of each true neighbour's leaf in its query's walk
    needed = []
    for q, best in zip(np.concatenate([queries, np.zeros((len(queries), 1))], 1), truth, strict=True):
        at = {x: i for i, x in enumerate(tree.best_bins(q, tree.leaves))}
        needed += [at[x] for x in leaf[best].tolist()]
    needed = np.asarray(needed)
    visits = 1
    while visits < tree.leaves and (needed < visits).mean() < target:  # widen
        visits *= 2
    low = visits // 2
    while visits - low > 1:
        middle = (low + visits) // 2
        low, visits = (low, middle) if (needed < middle).mean() >= target else (middle, visits)
    return min(tree.leaves, visits)


def bundles(counts: dict[int, int], leaves: int, most: int) -> tuple[np.ndarray, dict[int, int]]:
    """Bundle of each leaf - runs of leaves with ``most`` rows at most, or one larger leaf - and the
    parts that each bundle's rows are split in."""
    bundle, parts, at, held = np.zeros(max(1, leaves), np.int64), {0: 1}, 0, 0
    for leaf in range(leaves):
        n = counts.get(leaf, 0)
        if held and held + n > most:
            at, held = at + 1, 0
        bundle[leaf] = at
        held += n
        parts[at] = max(1, -(-held // most))
    return bundle, parts


class Block:
    """The ``keep`` best vectors of each query, of those in leaves that it visits; vectors come a few at a time."""

    def __init__(self, k1: np.ndarray, k2: np.ndarray, q: np.ndarray, seen: np.ndarray, keep: int, norm: float):
        self.k1, self.k2, self.q, self.seen, self.keep = k1, k2, q, seen, keep
        self.bar = np.full(len(q), -np.inf)
        self.slack = 1e-12 * norm * np.sqrt((q**2).sum(1))  # more than a product's rounding
        self.held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        self.more = 0

    def see(self, leaf: int, ids: np.ndarray, x: np.ndarray) -> None:
        who = np.flatnonzero(self.seen[:, leaf >> 3] >> (leaf & 7) & 1)
        for lo in range(0, len(who), 256):
            w = who[lo : lo + 256]
            s = self.q[w] @ x.T
            s[~np.isfinite(s)] = -np.inf
            bar = self.bar[w]
            if len(x) > self.keep:
                bar = np.maximum(bar, np.partition(s, -self.keep, 1)[:, -self.keep])
            i, j = np.nonzero((s >= (bar - self.slack[w])[:, None]) & (s > -np.inf))
            # summed alike for each pair, so that equal vectors tie
            score = (self.q[w[i]] * x[j]).sum(1)
            self.held.append((w[i], ids[j], score))
            self.more += len(i)
        if self.more > 100_000 + 4 * self.keep * len(self.q):
            self.best()

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        who, ids, score = (np.concatenate(c) for c in zip(*self.held, strict=True))
        order = np.lexsort((ids, -score, who))
        order = order[np.isfinite(score[order])]
        at = np.searchsorted(who[order], np.arange(len(self.q)))
        rank = np.arange(len(order)) - at[who[order]]
        order, rank = order[rank < self.keep], rank[rank < self.keep]
        last = order[rank == self.keep - 1]
        self.bar[who[last]] = score[last]
        self.held, self.more = [(who[order], ids[order], score[order])], 0
        return self.held[0]

    def found(self) -> pa.RecordBatch:
        who, ids, score = self.best()
        return pa.RecordBatch.from_arrays([pa.array(self.k1[who]), pa.array(self.k2[who]), pa.array(ids), pa.array(score)], schema=FOUND)


def compared(keep: int, norm: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of each unit (lane, part, block, part), whose queries come first (k1, k2, v and the bits of the
    leaves they visit), then its vectors by leaf (id as k1, leaf as k2, v)."""
    now, asked, block = None, [], None
    for batch in batches:
        unit = np.stack([batch.column(c).to_numpy() for c in (*UNIT, "kind")], 1)
        first, second = (batch.column(c).to_numpy() for c in ("k1", "k2"))
        opens = np.flatnonzero(np.append(True, (unit[1:] != unit[:-1]).any(1))) if len(unit) else []
        for lo, hi in zip(opens, [*opens[1:], len(unit)], strict=True):
            if tuple(unit[lo, :-1]) != now:
                if block:
                    yield block.found()
                now, asked, block = tuple(unit[lo, :-1]), [], None
            x = _matrix(batch.column("v").slice(lo, hi - lo))
            if not unit[lo, -1]:
                bits = np.stack([np.frombuffer(b, np.uint8) for b in batch.column("seen").slice(lo, hi - lo).to_pylist()])
                asked.append((first[lo:hi], second[lo:hi], x, bits))
                continue
            if asked and not block:
                block = Block(*(np.concatenate(c) for c in zip(*asked, strict=True)), keep, norm)
            ids, leaf = first[lo:hi], second[lo:hi]
            ends = np.flatnonzero(np.append(leaf[1:] != leaf[:-1], True)) + 1
            for a, b in zip([0, *ends[:-1]], ends, strict=True) if block else []:
                for c in range(a, b, LEAF_BLOCK):
                    d = min(b, c + LEAF_BLOCK)
                    block.see(int(leaf[c]), ids[c:d], x[c:d])
    if block:
        yield block.found()


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def usable(vector: Column, size: int) -> Column:
    """Not null, of the table's usual size, without null or non-finite components, not zero."""
    v = vector.cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) == size) & good & F.exists(v, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score: the k best found by inner product, ties to the least id.

    Vectors that are null, zero, of another size than most or hold null or non-finite components
    take no part, nor do null ids; rows that repeat an id and vector are found once; other columns
    are ignored; fewer candidates give fewer rows; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    common = vectors.select(F.size(vector).alias("n")).filter("n > 0").groupBy("n").count().orderBy(F.desc("count"), "n").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if common is None:
        return empty
    size = common["n"]
    rows = vectors.filter(is_query.isNotNull() & F.col(key).isNotNull() & usable(F.col(vector), size))
    v = F.col(vector).cast("array<double>")
    rows = rows.select(F.col(key).cast("long").alias("id"), v.alias("v"), is_query.alias("q"), F.xxhash64(v).alias("k1"), F.xxhash64(F.lit(5), v).alias("k2")).distinct()
    least = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("id"))
    points = materialize(rows.select("id", "v", "k1", "k2").withColumn("r", least).filter(F.col("r") <= k + 1), "points")
    queries = materialize(rows.filter("q").select("id", "v", "k1", "k2"), "queries")
    n, norm = points.agg(F.count("*"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))).first()
    if not n:
        return empty
    fitted = points.filter("r = 1").orderBy(F.xxhash64("k1", "id")).limit(SAMPLE).select("v").toArrow()["v"].combine_chunks()
    tried = queries.orderBy(F.xxhash64("k2", "id")).limit(CALIBRATE).select("v").toArrow()["v"].combine_chunks()
    sample, asked = _matrix(fitted), _matrix(tried)
    leaf_points = max(4, int(np.ceil(len(sample) / max(1, n / LEAF))))
    tree = Tree(augmented(sample, norm), leaf_points)
    visits = calibrate(tree, sample, asked, k + 1, norm, target) if len(asked) else tree.leaves
    shared = spark.sparkContext.broadcast(tree)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = shared.value.descend(augmented(_matrix(batch.column("v")), norm))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(leaf)], ["id", "v", "leaf"])

    indexed = materialize(points.select("id", "v").mapInArrow(index, "id long, v array<double>, leaf long"), "indexed")

    # leaves in tree order share a lane, so that a query returns one list a lane and not a leaf
    counts = {r["leaf"]: r["n"] for r in indexed.groupBy("leaf").agg(F.count("*").alias("n")).collect()}
    lane, lane_parts = bundles(counts, tree.leaves, -(-n // LANES))
    shared_lane = spark.sparkContext.broadcast(lane)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home, lanes, seen = [], [], []
            x = _matrix(batch.column("v"))
            for q in np.concatenate([x, np.zeros((len(x), 1))], 1):
                bins = shared.value.best_bins(q, visits)
                bits = np.zeros(max(1, shared.value.leaves), bool)
                bits[bins] = True
                home.append(bins[0])
                lanes.append(np.unique(shared_lane.value[bins]))
                seen.append(np.packbits(bits, bitorder="little").tobytes())
            rows = batch.select(["k1", "k2", "v"])
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(home, pa.int64()), pa.array(lanes, pa.list_(pa.int64())), pa.array(seen, pa.binary())], ["k1", "k2", "v", "leaf", "lanes", "seen"])

    asked_once = queries.dropDuplicates(["k1", "k2"]).select("k1", "k2", "v")
    visiting = materialize(asked_once.mapInArrow(walk, "k1 long, k2 long, v array<double>, leaf long, lanes array<long>, seen binary"), "visits")
    asking = {r["leaf"]: r["m"] for r in visiting.groupBy("leaf").agg(F.count("*").alias("m")).collect()}
    block, block_parts = bundles(asking, tree.leaves, QUERY_BLOCK)
    by_home = F.broadcast(spark.createDataFrame([(x, int(block[x]), block_parts[int(block[x])]) for x in asking] or [(-1, 0, 1)], "leaf long, block long, qs long"))
    by_leaf = F.broadcast(spark.createDataFrame([(x, int(lane[x]), lane_parts[int(lane[x])]) for x in counts], "leaf long, lane long, bs long"))
    by_lane = F.broadcast(spark.createDataFrame(list(lane_parts.items()), "lane long, bs long"))
    blocks = visiting.join(by_home, "leaf").withColumn("g", F.pmod(F.xxhash64("k1"), "qs"))

    def visited(asked: pa.Table) -> pa.Table:
        bits = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in asked["seen"].to_pylist()])
        leaves = np.flatnonzero(np.unpackbits(bits, bitorder="little"))
        return pa.table({"block": pa.array([asked["block"][0].as_py()] * len(leaves)), "g": pa.array([asked["g"][0].as_py()] * len(leaves)), "leaf": pa.array(leaves)})

    # a row a block and leaf, from the bits of at most QUERY_BLOCK queries
    wanted = blocks.select("block", "g", "seen").groupBy("block", "g").applyInArrow(visited, "block long, g long, leaf long")
    part = F.pmod(F.xxhash64("id"), "bs").alias("b")
    here = indexed.join(by_leaf, "leaf").join(wanted, "leaf").select("lane", part, "block", "g", F.lit(1).alias("kind"), F.col("id").alias("k1"), F.col("leaf").alias("k2"), "v", F.lit(None).cast("binary").alias("seen"))
    there = blocks.select("block", "g", "k1", "k2", "v", "seen", F.explode("lanes").alias("lane")).join(by_lane, "lane")
    there = there.select("lane", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bs") - 1)).alias("b"), "block", "g", F.lit(0).alias("kind"), "k1", "k2", "v", "seen")
    units = here.unionByName(there).repartition(*UNIT).sortWithinPartitions(*UNIT, "kind", "k2", "k1")
    found = units.mapInArrow(partial(compared, k + 1, norm), "k1 long, k2 long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("k1", "k2").orderBy(F.desc("score"), "vec_id"))
    best = found.withColumn("r", place).filter(F.col("r") <= k + 1)
    lists = best.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("l"))
    mine = queries.select(F.col("id").alias("query_id"), "k1", "k2").join(lists, ["k1", "k2"])
    others = F.slice(F.filter("l", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return mine.select("query_id", F.posexplode(others).alias("i", "x")).select("query_id", (F.col("i") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


UNIT = ["lane", "b", "block", "g"]
FOUND = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
