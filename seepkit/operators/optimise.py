"""Pareto fronts, minimax, cost-bounded integer scans and cheapest designs."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial, reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seepkit.sources.shared import discard, saved, saved_with


#: Distinct abscissas of a range that a two-dimensional front is sought in, about; ranges, at most, in as
#: many groups as a group has ranges.
RANGE, RANGES = 50_000, 1024


def splitters(values: DataFrame, column: str, parts: int) -> list:
    """Up to parts - 1 ascending numbers that cut a column into parts of about equal size: quantiles of a
    sketch, which the driver holds, so that they are the same wherever they are used."""
    if parts < 2:
        return []
    shares = [i / parts for i in range(1, parts)]
    found = values.agg(F.percentile_approx(F.col(column).cast("double"), shares, 50 * parts)).first()[0]
    return sorted(set(found or []))


def part_of(x: Column, cuts: list) -> Column:
    """How many cuts lie below or at x, found in two steps: among every n-th cut, then among the n behind it."""
    n = max(1, math.isqrt(len(cuts)))
    groups = [cuts[i : i + n] for i in range(0, len(cuts), n)]
    below = lambda c: F.size(F.filter(c, lambda v: v <= x))
    if not groups:
        return F.lit(0)
    heads, lists = (F.array(*(F.lit(float(g[0])) for g in groups)), F.array(*(F.array(*(F.lit(float(v)) for v in g)) for g in groups)))
    group = below(heads)
    return F.when(group == 0, 0).otherwise((group - 1) * n + below(F.element_at(lists, F.greatest(group, F.lit(1)))))


def pareto_2d(df: DataFrame, minimize: str, maximize: str) -> DataFrame:
    """Rows that no other row beats: as low and as high, and better in one. Ties all stay, rows with a null or
    NaN in either don't.

    Two steps bound what one task sees: the input shrinks to the best value per abscissa by an
    aggregate, which is written, then to the front within each of up to ``RANGES`` ranges of about as many
    abscissas, cut by quantiles of them, however they are spread; only ranges' extremes are compared
    across, so the window without a key reads a row per range.
    """
    x, y = F.col(minimize), F.col(maximize)
    known = df.dropna(subset=[minimize, maximize])
    best, seen = saved_with(known.groupBy(x.alias("x")).agg(F.max(y).alias("y")), "best", n=F.count(F.lit(1)))
    cuts = splitters(best, "x", min(RANGES, -(-seen["n"] // RANGE)))
    ranged = best.withColumn("part", part_of(F.col("x").cast("double"), cuts))
    within = Window.partitionBy("part").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("before", F.max("y").over(within)).filter(F.col("before").isNull() | (F.col("y") > F.col("before")))
    tops = ranged.groupBy("part").agg(F.max("y").alias("top"))
    across = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    floor = tops.select("part", F.max("top").over(across).alias("floor"))
    front = saved(local.join(floor, "part").filter(F.col("floor").isNull() | (F.col("y") > F.col("floor"))).select("x", "y"), "front")
    discard(best)
    names = unused(df.columns, "x", "y")
    front = front.toDF(*names)
    return df.join(front, (df[minimize] == front[names[0]]) & (df[maximize] == front[names[1]]), "left_semi")


def unused(columns: list[str], *wanted: str) -> list[str]:
    """The wanted names with underscores before them until they differ from the columns'."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


#: Points that one task holds and compares with others; cells of the space, at most.
HELD, CELLS = 8_192, 256


def front_rows(v: np.ndarray, block: int = 256) -> np.ndarray:
    """Places of the rows that no other row beats: as low everywhere and lower somewhere."""
    order = np.lexsort(v.T[::-1])  # a row is beaten only by earlier ones
    front = np.zeros(0, np.int64)
    for lo in range(0, len(order), block):
        some = order[lo : lo + block]
        some = some[~beaten_by(v[some], v[front])]
        some = some[~beaten_by(v[some], v[some])]
        front = np.concatenate([front, some])
    return front


def pareto_kd(df: DataFrame, minimize: list[str], maximize: list[str] = ()) -> DataFrame:
    """k objectives; ties all stay, rows with a null or NaN objective don't.

    Points - distinct objectives - that a batch's or a task's own points beat go first. The rest meet in a grid
    of cells, cut by quantiles of every objective: a cell all of whose coordinates are above another's is
    beaten as a whole, and a cell need be compared only with cells that are above it nowhere. What is left
    of a cell is dealt to tasks of up to ``HELD`` points, past which the points of the cells below stream.
    The driver sees the number of points in each of up to ``CELLS`` cells.
    """
    goals = [F.col(c).cast("double") for c in minimize] + [-F.col(c).cast("double") for c in maximize]
    names = [f"o{i}" for i in range(len(goals))]
    points = df.dropna(subset=[*minimize, *maximize]).select(*(F.when(g == 0, 0.0).otherwise(g).alias(n) for n, g in zip(names, goals, strict=True)))
    schema = pa.schema([(n, pa.float64()) for n in names])

    def local_front(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, len(names)))
        for batch in batches:
            v = np.concatenate([held, np.unique(np.stack([c.to_numpy() for c in batch.columns], 1), axis=0)])
            held = v[front_rows(v)]
            if len(held) > HELD:  # too many to be held against what follows
                yield pa.RecordBatch.from_arrays(list(held.T), schema=schema)
                held = held[:0]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in held.T], schema=schema)

    few = points.mapInArrow(local_front, points.schema).distinct()
    few, seen = saved_with(few, "points", n=F.count(F.lit(1)))
    front = saved(_merged(few, names, seen["n"]), "front")
    discard(few)
    new = unused(df.columns, *names)
    front = front.toDF(*new)
    same = reduce(lambda x, y: x & y, (F.when(g == 0, 0.0).otherwise(g) == F.col(n) for g, n in zip(goals, new, strict=True)))
    return df.join(front, same, "left_semi")


def _merged(points: DataFrame, names: list[str], n: int) -> DataFrame:
    """The points that none of them beats."""
    per_axis = int(min(CELLS, max(1, n / HELD)) ** (1 / len(names)) + 1e-9) + (n > HELD)
    per_axis = max(1, min(per_axis, int(CELLS ** (1 / len(names)) + 1e-9)))
    cuts = [splitters(points, c, per_axis) for c in names]
    celled = points.withColumn("cell", reduce(lambda x, y: x + y, (part_of(F.col(c), v) * per_axis**i for i, (c, v) in enumerate(zip(names, cuts, strict=True)))))
    sizes = {r["cell"]: r["n"] for r in celled.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    at = {c: tuple(c // per_axis**i % per_axis for i in range(len(names))) for c in sizes}
    alive = [c for c in at if not any(all(x < y for x, y in zip(at[o], at[c], strict=True)) for o in at)]
    below = {o: [c for c in alive if all(x <= y for x, y in zip(at[o], at[c], strict=True))] for o in alive}
    if not alive:
        return points
    blocks = {c: -(-sizes[c] // HELD) for c in alive}

    def chosen(table: dict, kind: str) -> Column:
        made = F.create_map(*(x for c, v in table.items() for x in (F.lit(c), F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v))))
        return F.element_at(made, F.col("cell")).cast(kind)

    kept = celled.filter(F.col("cell").isin(alive))
    own = kept.select(*names, "cell", F.pmod(F.xxhash64(*names), chosen(blocks, "long")).cast("int").alias("block"), F.lit(0).alias("asks"))
    asked = kept.withColumn("to", F.explode(chosen(below, "array<int>"))).drop("cell").withColumnRenamed("to", "cell")
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), chosen(blocks, "int") - 1))).select(*names, "cell", "block", F.lit(1).alias("asks"))
    dealt = own.union(asked).repartition("cell", "block").sortWithinPartitions("cell", "block", "asks")
    return dealt.mapInArrow(partial(_unbeaten, len(names)), ", ".join(f"{n} double" for n in names))


def _unbeaten(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block's own points, which come first, those that no other of its points beats."""
    held, now = np.zeros((0, k)), None
    names = [f"o{i}" for i in range(k)]
    for batch in batches:
        v = np.stack([c.to_numpy() for c in batch.columns[:k]], 1)
        block = np.stack([c.to_numpy() for c in batch.columns[k : k + 2]], 1)
        asks = batch.column(k + 2).to_numpy().astype(bool)
        edges = [0, *(np.flatnonzero((block[1:] != block[:-1]).any(1)) + 1).tolist(), len(v)]
        for lo, hi in pairwise(edges):
            if lo == hi:
                continue
            if tuple(block[lo]) != now:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in held.T], names)
                now, held = tuple(block[lo]), np.zeros((0, k))
            own = v[lo:hi][~asks[lo:hi]]
            held = np.concatenate([held, own]) if len(own) else held
            others = v[lo:hi][asks[lo:hi]]
            if len(others) and len(held):
                held = held[~beaten_by(held, others[front_rows(others)])]
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in held.T], names)


def beaten_by(v: np.ndarray, others: np.ndarray, block: int = 512) -> np.ndarray:
    """Which rows some other row beats: as low everywhere and lower somewhere."""
    out = np.zeros(len(v), bool)
    for i in range(0, len(v), block):
        for j in range(0, len(others), 4096):
            some = np.flatnonzero(~out[i : i + block]) + i
            mine, by = v[some], others[j : j + 4096]
            no_worse, better = np.ones((len(some), len(by)), bool), np.zeros((len(some), len(by)), bool)
            for c in range(v.shape[1]):
                no_worse &= by[:, c] <= mine[:, c, None]
                better |= by[:, c] < mine[:, c, None]
            out[some[(no_worse & better).any(1)]] = True
    return out


def worst_case(df: DataFrame, design: list[str], losses: list[str]) -> DataFrame:
    """Each design's worst loss per objective over its scenarios."""
    return df.groupBy(*design).agg(*(F.max(c).alias(c) for c in losses))


def minimax_front(df: DataFrame, design: list[str], scenario_loss: str, other: str) -> DataFrame:
    """Front of (worst scenario loss, other objective), both to be low: reading (a)."""
    rows = df.groupBy(*design).agg(F.max(scenario_loss).alias("worst"), F.max(other).alias("other")).withColumn("gain", -F.col("other"))
    return pareto_2d(rows, "worst", "gain").drop("gain")


def minimax_point(df: DataFrame, objectives: list[str], keys: list[str]) -> DataFrame:
    """The row whose largest objective, each scaled to its range, is least: reading (b)."""
    ranges = df.agg(*(f(c).alias(f"__{n}_{c}") for c in objectives for n, f in (("lo", F.min), ("hi", F.max))))
    scaled = [F.when(F.col(f"__hi_{c}") > F.col(f"__lo_{c}"), (F.col(c) - F.col(f"__lo_{c}")) / (F.col(f"__hi_{c}") - F.col(f"__lo_{c}"))).otherwise(0.0) for c in objectives]
    worst = F.greatest(*scaled) if len(scaled) > 1 else scaled[0]
    joined = df.join(F.broadcast(ranges))  # one row
    return joined.withColumn("minimax", worst).orderBy("minimax", *keys).limit(1).select(*df.columns, "minimax")


def int_scan(spark, unit_costs: list[float], bound: float) -> DataFrame:
    """All tuples x >= 0 of integers with cost c.x <= bound: x1.., cost. Bounds depend on what the
    earlier variables left, so no tuple beyond the bound is made. Costs must be above 0."""
    _positive(unit_costs)
    out = spark.range(1).select(F.lit(0.0).alias("cost"))
    names = []
    for i, c in enumerate(unit_costs, 1):
        most = F.floor((F.lit(bound) - F.col("cost")) / F.lit(float(c)) + 1e-9).cast("int")
        out = out.select(*names, "cost", F.explode(F.sequence(F.lit(0), most)).alias(f"x{i}")).withColumn("cost", F.col("cost") + F.col(f"x{i}") * float(c))
        names.append(f"x{i}")
        if i == 1:
            out = out.repartition("x1")  # later variables are made by many tasks
    return out.select(*names, "cost")


def min_cost(designs: DataFrame, feasible: Column, keys: list[str]) -> DataFrame:
    """The cheapest feasible design; ties to the least keys."""
    return designs.filter(feasible).orderBy("cost", *keys).limit(1)


def _positive(unit_costs: list[float]) -> None:
    if not unit_costs or any(not 0 < c < math.inf for c in unit_costs):
        raise ValueError(f"unit costs must be numbers above 0: {unit_costs}")


def shell(spark, unit_costs: list[float], gains: list[float], need: float, low: float, high: float) -> DataFrame:
    """Integer tuples x >= 0 with gains.x >= need and low <= costs.x < high: x1.., cost. A branch is made only
    if what is left of the cost can still bring what is missing, and the last number starts where both the
    shell and the need begin."""
    slack = 1e-9 * max(1.0, high)
    out, names, last = spark.range(1).select(F.lit(0.0).alias("cost"), F.lit(0.0).alias("gain")), [], len(unit_costs)
    for i, (c, g) in enumerate(zip(unit_costs, gains, strict=True), 1):
        x, cost, gain = F.col(f"x{i}"), F.col("cost"), F.col("gain")
        most = F.ceil((F.lit(high) - cost) / c - slack).cast("long") - 1
        least = F.lit(0).cast("long")
        if i == last:
            least = F.greatest(least, F.ceil((F.lit(low) - cost) / c - slack).cast("long"), *([F.ceil((F.lit(need) - gain) / g - slack).cast("long")] if g > 0 else []))
        made = out.withColumn("least", least).withColumn("most", most).filter("most >= least")
        out = made.select(*names, "cost", "gain", F.explode(F.sequence("least", "most")).alias(f"x{i}"))
        names.append(f"x{i}")
        out = out.select(*names, (cost + x * c).alias("cost"), (gain + x * g).alias("gain"))
        best = max((q / p for p, q in zip(unit_costs[i:], gains[i:], strict=True)), default=0.0)
        out = out.filter(F.col("gain") + (F.lit(high) - F.col("cost")) * best >= need - slack)
        if i == 1:
            out = out.repartition("x1")  # later numbers are made by many tasks
    return out.filter((F.col("cost") >= low - slack) & (F.col("cost") < high)).select(*names, "cost")


def cheapest_design(spark, unit_costs: list[float], gains: list[float], need: float | None, bound: float, width: float | None = None) -> tuple[DataFrame, dict]:
    """The cheapest integer tuple with gains.x >= need and costs.x <= bound, ties to the least numbers, in a frame
    of one row, or none; and what the search took: ``shells``, ``made`` rows.

    Shells of rising cost, ``width`` wide (by default the largest unit cost), are searched from the least cost
    that any tuple can have that gains enough; the first shell with a tuple in it holds the cheapest. A need
    of None can't be met.
    """
    _positive(unit_costs)
    names = [f"x{i}" for i in range(1, len(unit_costs) + 1)]
    schema = ", ".join(f"{n} long" for n in names) + ", cost double"
    took = {"shells": 0, "made": 0}
    rate = max(g / c for g, c in zip(gains, unit_costs, strict=True))
    if need is None or (need > 0 and rate <= 0):
        return spark.createDataFrame([], schema), took
    width = max(unit_costs) if width is None else width
    low = max(0.0, need / rate if need > 0 else 0.0)
    top = math.nextafter(bound * (1 + 1e-12) + 1e-12, math.inf)
    while low < top:
        high = min(low + width, top)
        found = shell(spark, unit_costs, gains, need, low, high)
        rounded = F.struct(F.round("cost", 9).alias("cost"), *names)
        r = found.agg(F.count("*").alias("n"), F.min(rounded).alias("best")).first()  # one row
        took["shells"] += 1
        took["made"] += r["n"]
        if r["n"]:
            return spark.createDataFrame([(*(int(r["best"][n]) for n in names), float(r["best"]["cost"]))], schema), took
        low = high
    return spark.createDataFrame([], schema), took
