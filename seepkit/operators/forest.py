"""Minimum spanning forests and bottleneck paths of edge lists, by Borůvka's rounds.

In a round every component picks its least outgoing edge (an aggregate with map-side combining), the
picked edges are contracted (pointers are doubled until they reach a root), and edges get their
components' names, of which the least between two components stays. Components at least halve in
number, so the rounds grow with the logarithm of the nodes. Edges are ordered by (weight, ends), so
picks never form a ring. A graph - a trial - of up to ``LOCAL`` edges is reduced within a task first;
a larger one is dealt to many. Every table of a round is written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seepkit.operators.sets import UnionFind
from seepkit.sources.shared import discard, saved, saved_with

#: Edges of a trial that one task reduces at once; larger trials are dealt to several tasks by hash.
LOCAL = 250_000
EDGE = "trial long, u long, v long, w long"
#: Rounds, and doublings of a pointer: far beyond what 2^63 nodes need.
MOST = 100


def _edges(edges: DataFrame) -> DataFrame:
    """Edges with u < v, written once; loops and rows with a null are left out."""
    known = edges.select(*(F.col(c).cast("long") for c in ("trial", "u", "v", "w"))).dropna().filter("u <> v")
    return saved(known.select("trial", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "w"), "edges")


def _reduced(edges: DataFrame, ends: tuple[int, int] | None) -> DataFrame:
    """``EDGE`` and ``whole``: each part's own spanning forest - an edge that closes a ring in a part is in no
    minimum spanning forest. ``whole``: the part is the whole trial. With ``ends`` a whole trial gives one
    edge at most, from one end to the other with the weight at which they come together."""
    sizes = edges.groupBy("trial").agg(F.ceil(F.count("*") / LOCAL).cast("int").alias("parts"))
    dealt = edges.join(sizes, "trial").withColumn("part", F.pmod(F.xxhash64("u", "v"), F.col("parts")))
    dealt = dealt.repartition("trial", "part").sortWithinPartitions("trial", "part", "w", "u", "v")
    schema = pa.schema([*((c, pa.int64()) for c in ("trial", "u", "v", "w")), ("whole", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sets, over = None, UnionFind(), False
        for batch in batches:
            out = []
            for trial, u, v, w, parts, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (trial, part) != now:
                    now, sets, over = (trial, part), UnionFind(), False
                if over or not sets.join(u, v):
                    continue
                if parts > 1 or ends is None:
                    out.append({"trial": trial, "u": u, "v": v, "w": w, "whole": parts == 1})
                elif sets.find(ends[0]) == sets.find(ends[1]):
                    out.append({"trial": trial, "u": ends[0], "v": ends[1], "w": w, "whole": True})
                    over = True
            yield pa.RecordBatch.from_pylist(out, schema)

    return dealt.select("trial", "u", "v", "w", "parts", "part").mapInArrow(run, f"{EDGE}, whole boolean")


def _picks(graph: DataFrame) -> DataFrame:
    """trial, u, w, a, b, v: each component's least edge, its original ends, and the component behind it."""
    both = graph.select("trial", F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e"), "w", "a", "b")
    least = both.groupBy("trial", F.col("e.u").alias("u")).agg(F.min(F.struct("w", "a", "b", F.col("e.v").alias("v"))).alias("m"))
    return least.select("trial", "u", "m.w", "m.a", "m.b", "m.v")


def _roots(picks: DataFrame) -> DataFrame:
    """trial, u, root: picks contracted. The smaller of two that picked the same edge is a root; all others
    look twice as far in each step until nobody moves."""
    on = picks.select("trial", F.col("u").alias("v"), F.col("v").alias("back"))
    at = picks.join(on, ["trial", "v"]).select("trial", "u", F.when((F.col("back") == F.col("u")) & (F.col("u") < F.col("v")), F.col("u")).otherwise(F.col("v")).alias("root"))
    at = saved(at, "roots")
    for _ in range(MOST):
        on = at.select("trial", F.col("u").alias("root"), F.col("root").alias("next"))
        moved = at.join(on, ["trial", "root"]).select("trial", "u", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved"))
        further, seen = saved_with(moved, "roots", moved=F.count_if("moved"))
        discard(at)
        at = further
        if not seen["moved"]:
            return at.drop("moved")
    raise ArithmeticError("picked edges form a ring")


def _contracted(graph: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges between components: the least one between any two."""
    for end in ("u", "v"):
        on = labels.select("trial", F.col("u").alias(end), F.col("root").alias(f"root_{end}"))
        graph = graph.join(on, ["trial", end])
    across = graph.filter("root_u <> root_v").select("trial", F.least("root_u", "root_v").alias("u"), F.greatest("root_u", "root_v").alias("v"), F.struct("w", "a", "b").alias("m"))
    return across.groupBy("trial", "u", "v").agg(F.min("m").alias("m")).select("trial", "u", "v", "m.w", "m.a", "m.b")


def spanning_forest(edges: DataFrame) -> DataFrame:
    """trial, u, v, w (u < v): the edges of each trial's minimum spanning forest, ties to the least ends.

    edges: trial, u, v, w, integers; parallel edges, loops and rows with a null don't matter; an empty list
    gives none. The result is a table in the shared folder.
    """
    given = _edges(edges)
    first = saved(_reduced(given, None), "edges")
    discard(given)
    forest = first.filter("whole").drop("whole")
    graph, staged = saved_with(first.filter("NOT whole").select("trial", "u", "v", "w", F.col("u").alias("a"), F.col("v").alias("b")), "edges", n=F.count(F.lit(1)))
    parts, picked = [], staged["n"]
    for _ in range(MOST):
        if not picked:
            break
        picks = saved(_picks(graph), "picks")
        parts.append(picks)
        labels = _roots(picks)
        further, seen = saved_with(_contracted(graph, labels), "edges", n=F.count(F.lit(1)))
        discard(graph, labels)
        graph, picked = further, seen["n"]
    for picks in parts:  # an edge may be picked from both sides
        forest = forest.union(picks.select("trial", F.col("a").alias("u"), F.col("b").alias("v"), "w").distinct())
    out = saved(forest, "forest")
    discard(first, graph, *parts)
    return out


def bottlenecks(edges: DataFrame, source: int, target: int) -> DataFrame:
    """trial, w: the least weight so that edges up to it join the nodes ``source`` and ``target``, for trials in
    which any do. The result is a table in the shared folder.

    While the two are in different components, a path between them must use an edge out of each; and all
    edges within a component on the way from a node to its rim weigh at most what some component of that
    node had as its least edge out. So the answer is the largest of the least edges out of the source's and
    the target's components, over the rounds until they are one.
    """
    given = _edges(edges)
    first = saved(_reduced(given, (source, target)), "edges")
    discard(given)
    found = first.filter("whole").select("trial", "w")
    graph, seen = saved_with(first.filter("NOT whole").select("trial", "u", "v", "w", F.col("u").alias("a"), F.col("v").alias("b")), "edges", n=F.count(F.lit(1)))
    marks = saved(graph.select("trial", F.lit(source).cast("long").alias("s"), F.lit(target).cast("long").alias("t"), F.lit(None).cast("long").alias("worst")).distinct(), "marks")
    parts, left = [], seen["n"]
    for _ in range(MOST):
        if not left:
            break
        picks = saved(_picks(graph), "picks")
        labels = _roots(picks)
        at = marks
        for end in ("s", "t"):  # an end without edges out is never joined: the trial drops out
            at = at.join(picks.select("trial", F.col("u").alias(end), F.col("w").alias(f"w_{end}")), ["trial", end])
            at = at.join(labels.select("trial", F.col("u").alias(end), F.col("root").alias(f"root_{end}")), ["trial", end])
        moved = saved(at.select("trial", F.col("root_s").alias("s"), F.col("root_t").alias("t"), F.greatest("worst", "w_s", "w_t").alias("worst")), "marks")
        parts.append(moved)
        found = found.union(moved.filter("s = t").select("trial", F.col("worst").alias("w")))
        discard(marks)
        marks = moved.filter("s <> t")
        open_ = labels.join(marks.select("trial"), "trial", "left_semi")
        further, seen = saved_with(_contracted(graph, open_), "edges", n=F.count(F.lit(1)))
        discard(graph, labels, picks)
        graph, left = further, seen["n"]
    out = saved(found, "bottlenecks")
    discard(first, graph, *parts)
    return out
