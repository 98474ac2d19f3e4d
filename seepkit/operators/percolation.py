"""Monte Carlo percolation: seeded particles, incremental union-find, curves over filling amounts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seepkit.functions.rng import u01
from seepkit.operators.contact import contacts, touches
from seepkit.operators.forest import bottlenecks
from seepkit.operators.sets import UnionFind


def sample_points(spark: SparkSession, seed: int, trials: int, n: int) -> DataFrame:
    """trial, i, x, y: uniform points in the unit square."""
    grid = spark.range(trials).select(F.col("id").alias("trial"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    return grid.select("trial", "i", u01(seed, "trial", "i", F.lit("x")).alias("x"), u01(seed, "trial", "i", F.lit("y")).alias("y"))


def sample_cylinders(spark: SparkSession, seed: int, trials: int, n: int, box: float = 1.0, r: float = 0.02, h: float = 0.15) -> DataFrame:
    """``place_cylinders`` for n bodies in each of the trials 0, 1, ..."""
    return place_cylinders(spark.range(trials).select(F.col("id").alias("trial"), F.lit(n).alias("n")), seed, box, r, h)


def place_cylinders(trials: DataFrame, seed: int, box: float = 1.0, r: float = 0.02, h: float = 0.15) -> DataFrame:
    """trial, i and struct ``body`` for ``n`` bodies (column, null is none) of each ``trial``: centres uniform in a
    cube, axes uniform on the sphere, a function of seed, trial and i alone."""
    grid = trials.filter("n > 0").select("trial", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("i"))

    def u(name: str):
        return u01(seed, "trial", "i", F.lit(name))

    z, phi = 2 * u("u") - 1, 2 * math.pi * u("v")
    s = F.sqrt(1 - z * z)
    fields = {"cx": box * u("x"), "cy": box * u("y"), "cz": box * u("z"), "ax": s * F.cos(phi), "ay": s * F.sin(phi), "az": z, "r": F.lit(r), "h": F.lit(h)}
    return grid.select("trial", "i", F.struct(*(v.alias(k) for k, v in fields.items())).alias("body"))


def prefix(particles: DataFrame, n: int) -> DataFrame:
    """The design of n particles: the first n of the shared sequence."""
    return particles.filter(F.col("i") < n)


def critical_fill(points: DataFrame, reach: float) -> DataFrame:
    """trial, crit: the least number of points, in order, that join x <= reach to x >= 1 - reach.

    Points are in contact at distance <= reach; crit is null when the trial never spans. A trial's
    points, fixed in number by the design, are one group; a grid limits comparisons to neighbours.
    """
    import pandas as pd

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        n = len(pdf)
        sets, cells = UnionFind(), {}
        crit = None
        for j, (x, y) in enumerate(zip(pdf["x"], pdf["y"], strict=True)):
            cx, cy = int(x / reach), int(y / reach)
            for gx in (cx - 1, cx, cx + 1):
                for gy in (cy - 1, cy, cy + 1):
                    for k, px, py in cells.get((gx, gy), ()):
                        if (px - x) ** 2 + (py - y) ** 2 <= reach * reach:
                            sets.join(j, k)
            cells.setdefault((cx, cy), []).append((j, x, y))
            if x <= reach:
                sets.join(j, n)
            if x >= 1 - reach:
                sets.join(j, n + 1)
            if sets.find(n) == sets.find(n + 1):
                crit = j + 1
                break
        return pd.DataFrame({"trial": [pdf["trial"].iloc[0]], "crit": pd.array([crit], "Int64")})

    return points.groupBy("trial").applyInPandas(one, "trial long, crit long")


#: Nodes that stand for the two faces; bodies are numbered from 0.
FACES = (-1, -2)


def filling_edges(bodies: DataFrame, tol: float, axis: str = "x", low: float = 0.0, high: float = 1.0) -> DataFrame:
    """trial, u, v, w: contacts of cylinders with each other and with the faces ``axis = low`` and ``axis = high``
    (nodes ``FACES``), and how many bodies there must be for them: one more than the later one's number."""
    edges = contacts(bodies, tol).select("trial", F.col("i").alias("u"), F.col("j").alias("v"), (F.greatest("i", "j") + 1).alias("w"))
    for face, (at, sign) in zip(FACES, ((low, -1), (high, 1)), strict=True):
        edges = edges.union(touches(bodies, axis, at, sign, tol).select("trial", F.lit(face).alias("u"), F.col("i").alias("v"), F.col("i") + 1))
    return edges.select(*(F.col(c).cast("long").alias(c) for c in ("trial", "u", "v", "w")))


def fill_of_edges(edges: DataFrame, trials: DataFrame) -> DataFrame:
    """trial, crit: the weight at which the edges join the two faces, null where they never do. This is the least
    largest edge on a way from face to face, a bottleneck in the minimum spanning forest; no task holds a
    trial (``forest``), however many bodies it has. trials: a column ``trial``."""
    found = bottlenecks(edges, *FACES).withColumnRenamed("w", "crit")
    return trials.select(F.col("trial").cast("long").alias("trial")).distinct().join(found, "trial", "left")


def cylinder_fill(bodies: DataFrame, tol: float, axis: str = "x", low: float = 0.0, high: float = 1.0) -> DataFrame:
    """trial, crit: the least number of cylinders, in the order of ``i`` (0, 1, ...), that join the face
    ``axis = low`` to the face ``axis = high``; null for trials that never span. bodies: trial, i, body."""
    return fill_of_edges(filling_edges(bodies, tol, axis, low, high), bodies)


def point_contacts(points: DataFrame, reach: float) -> DataFrame:
    """trial, i, j with i < j of points at distance <= reach: cells of that width, an equi-join with 5 of the 9
    around, since the points in the other 4 ask this one."""
    cells = points.select("trial", "i", "x", "y", *(F.floor(F.col(c) / reach).cast("long").alias(k) for c, k in (("x", "p"), ("y", "q"))))
    steps = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1)))))
    others = cells.select("trial", F.col("i").alias("j"), F.col("x").alias("bx"), F.col("y").alias("by"), "p", "q", steps.alias("o"))
    others = others.select("trial", "j", "bx", "by", ((F.col("o.a") == 0) & (F.col("o.b") == 0)).alias("own"), (F.col("p") + F.col("o.a")).alias("p"), (F.col("q") + F.col("o.b")).alias("q"))
    dx, dy = F.col("x") - F.col("bx"), F.col("y") - F.col("by")
    once = ~F.col("own") | (F.col("i") < F.col("j"))
    met = cells.join(others, ["trial", "p", "q"]).filter(once & (F.col("i") != F.col("j")) & (dx * dx + dy * dy <= reach * reach))
    return met.select("trial", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))


def point_fill(points: DataFrame, reach: float) -> DataFrame:
    """As ``critical_fill``, for trials of any size: a bottleneck of all contacts instead of a group a trial."""
    edges = point_contacts(points, reach).select("trial", F.col("i").alias("u"), F.col("j").alias("v"), (F.col("j") + 1).alias("w"))
    for face, near in zip(FACES, (F.col("x") <= reach, F.col("x") >= 1 - reach), strict=True):
        edges = edges.union(points.filter(near).select("trial", F.lit(face).alias("u"), F.col("i").alias("v"), (F.col("i") + 1).alias("w")))
    return fill_of_edges(edges, points)


def spans(crit: DataFrame, n: int) -> DataFrame:
    """trial, hit: whether the design of n particles spans."""
    return crit.select("trial", F.coalesce(F.col("crit") <= n, F.lit(False)).alias("hit"))


def percolation_curve(crit: DataFrame, fills: list[int]) -> DataFrame:
    """n_fill, k, trials, p_hat for each filling amount."""
    rows = crit.select("crit", F.explode(F.array(*(F.lit(n).cast("long") for n in fills))).alias("n_fill"))
    made = rows.groupBy("n_fill").agg(F.sum(F.when(F.col("crit") <= F.col("n_fill"), 1).otherwise(0)).alias("k"), F.count("*").alias("trials"))
    return made.withColumn("p_hat", F.col("k") / F.col("trials"))
