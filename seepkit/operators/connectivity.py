"""Connected components of an edge list, without gathering it anywhere.

Each task first joins its own edges, some at a time, into stars (``LOCAL``). Then alternating large-star and small-star rounds (Kiveris et al. 2014): each node's neighbours are
linked to the least of them, which keeps components and shortens paths until every node points at
the least node of its component. A hot node's edges are never listed in one task: each round needs
the least neighbour by node - an aggregate with map-side combining - and a join that Spark can
split. Every round is written to the shared folder, so that a lost executor repeats one round.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seepkit.operators.sets import UnionFind
from seepkit.sources.shared import discard, saved, saved_with


#: Edges that a task joins at a time.
LOCAL = 250_000


class NotConverged(RuntimeError):
    """Rounds ran out before the components were found."""


def _stars(edges: DataFrame) -> DataFrame:
    """u, v with the same nodes and components: of each run of a task's edges every node points at the least of
    those it hangs together with there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, held, kinds = UnionFind(), 0, None

        def made() -> pa.RecordBatch:
            nodes = list(sets.up)
            return pa.RecordBatch.from_arrays([pa.array(nodes, kinds[0]), pa.array([sets.find(x) for x in nodes], kinds[1])], ["u", "v"])

        for batch in batches:
            kinds = batch.schema.types
            for lo in range(0, len(batch), LOCAL):
                some = batch.slice(lo, LOCAL)
                for u, v in zip(*(c.to_pylist() for c in some.columns), strict=True):
                    sets.join(u, v)
                held += len(some)
                if held >= LOCAL:
                    yield made()
                    sets, held = UnionFind(), 0
        if held:
            yield made()

    return edges.mapInArrow(run, edges.schema)


def components(edges: DataFrame, src: str = "src", dst: str = "dst", most_rounds: int = 100) -> DataFrame:
    """(node, comp): every node of an edge and the least node of its component.

    Loops keep their node; rows with a null end are ignored; repeated and reversed edges don't matter;
    an empty edge list gives an empty result. The number of rounds grows with the logarithm of the longest
    path; ``NotConverged`` is raised if ``most_rounds`` aren't enough. The result is a table in the
    shared folder.
    """
    both = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).dropna()
    # edges point from the larger node to the smaller; a star's middle is a loop
    mark = {"n": F.count(F.lit(1)), "total": F.sum(F.hash("u", "v").cast("long")), "mixed": F.bit_xor(F.xxhash64("u", "v"))}
    link = F.col("u") != F.col("v")
    begin = {"n": F.count_if(link), "total": F.sum(F.when(link, F.hash("u", "v").cast("long"))), "mixed": F.bit_xor(F.when(link, F.xxhash64("u", "v")))}
    first, last = saved_with(_stars(both).distinct(), "edges", **begin)
    graph = first.filter(link)
    stale: DataFrame | None = None
    for _ in range(most_rounds):
        # large star: larger neighbours of u go to the least of u and its neighbours
        around = graph.union(graph.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = around.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        graph, state = saved_with(small, "stars", **mark)
        if stale is not None:
            discard(stale)
        stale = graph
        if state == last:  # a round that changes nothing: every node points at its component's least
            break
        last = state
    else:
        raise NotConverged(f"components after {most_rounds} rounds")
    nodes = first.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    found = nodes.join(graph.select(F.col("u").alias("node"), F.col("v").alias("m")), "node", "left")
    out = saved(found.select("node", F.coalesce("m", "node").alias("comp")), "components")
    discard(first, graph)
    return out
