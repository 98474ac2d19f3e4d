import random

import pytest
from pyspark.sql import functions as F

from seepkit.operators import forest
from seepkit.operators.contact import FIELDS, contacts, touches
from seepkit.operators.forest import bottlenecks, spanning_forest
from seepkit.operators.percolation import critical_fill, cylinder_fill, point_fill, sample_cylinders, sample_points
from seepkit.operators.sets import UnionFind

SCHEMA = "trial long, u long, v long, w long"


def kruskal(rows):
    """Forest edges, and the weight at which nodes 0 and 1 come together."""
    out, joined = [], {}
    for trial in {r[0] for r in rows}:
        sets = UnionFind()
        mine = sorted({(w, min(u, v), max(u, v)) for t, u, v, w in rows if t == trial and u != v})
        for w, u, v in mine:
            if sets.join(u, v):
                out.append((trial, u, v, w))
            if trial not in joined and sets.find(0) == sets.find(1):
                joined[trial] = w
    return sorted(out), joined


def drawn(seed, nodes, edges, trials=4):
    r = random.Random(seed)
    rows = [(t, *r.choices(range(nodes + 5 * t), k=2), r.randrange(edges // 3)) for t in range(trials) for _ in range(edges)]
    rows += [(9, i, i + 1, i) for i in range(1, 60)] + [(9, 0, 40, 3), (10, 0, 5, 1), (10, 1, 6, 1), (11, 0, 1, 7), (11, 1, 0, 5), (12, 3, 3, 1), (13, 5, 6, 2)]
    return rows


@pytest.mark.parametrize(("local", "seed"), [(3, 1), (20, 2), (250_000, 3)])
def test_forests_and_bottlenecks_equal_kruskal(spark, monkeypatch, local, seed):
    monkeypatch.setattr(forest, "LOCAL", local)
    rows = drawn(seed, 30, 60)
    df = spark.createDataFrame([*rows, (None, 1, 2, 3), (0, None, 1, 1), (0, 1, 2, None)], SCHEMA).repartition(3)
    want, joined = kruskal(rows)
    assert sorted(tuple(r) for r in spanning_forest(df).collect()) == want
    assert {r.trial: r.w for r in bottlenecks(df, 0, 1).collect()} == joined
    assert set(joined) >= {9, 11}
    assert not {10, 12, 13} & set(joined)


def test_forests_of_nothing(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert spanning_forest(df).count() == bottlenecks(df, 0, 1).count() == 0


@pytest.mark.parametrize("local", [10, 250_000])
def test_cylinders_fill_as_they_are_added(spark, monkeypatch, local):
    monkeypatch.setattr(forest, "LOCAL", local)
    bodies = sample_cylinders(spark, 4, 5, 60, r=0.08, h=0.2).filter("trial < 4 OR i < 3")
    tol = 0.01
    got = {r.trial: r.crit for r in cylinder_fill(bodies, tol).collect()}
    edges = [tuple(r) for r in contacts(bodies, tol).select("trial", "i", "j").collect()]
    low, high = ({tuple(r) for r in touches(bodies, "x", at, sign, tol).collect()} for at, sign in ((0.0, -1), (1.0, 1)))
    for trial in range(5):
        crit = None
        for n in range(61):  # the design of n bodies, anew
            sets = UnionFind()
            for t, i, j in edges:
                if t == trial and max(i, j) < n:
                    sets.join(i, j)
            roots = [{sets.find(i) for t, i in side if t == trial and i < n} for side in (low, high)]
            if roots[0] & roots[1]:
                crit = n
                break
        assert got[trial] == crit
    assert got[4] is None
    assert any(got.values())


def test_no_task_holds_a_large_trial(spark, monkeypatch):
    monkeypatch.setattr(forest, "LOCAL", 2_000)
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"  # small partitions would be read together
    was = spark.conf.get(coalesce)
    spark.conf.set(coalesce, "false")
    df = spark.range(20_000).select(F.lit(0).alias("trial"), F.col("id").alias("u"), (F.col("id") + 1).alias("v"), (F.col("id") % 977).alias("w"))
    dealt = forest._reduced(forest._edges(df), (0, 20_000))
    sizes = [r[1] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    spark.conf.set(coalesce, was)
    assert sum(sizes) == 20_000  # a chain: every edge is in the forest
    assert len(sizes) > 1
    assert not dealt.filter("whole").count()
    assert bottlenecks(df, 0, 20_000).first().w == 976


def test_bodies_of_mixed_size_meet(spark):
    from seepkit.operators import contact

    r = random.Random(12)
    rows = []
    for i in range(260):
        size = 2.0 if i == 7 else 0.3 if i % 50 == 0 else r.choice([0.01, 0.04])
        a = [r.gauss(0, 1) for _ in range(3)]
        n = sum(x * x for x in a) ** 0.5
        rows.append((i % 2, i, (*(r.random() for _ in range(3)), *(x / n for x in a), size * 0.3, size)))
    kind = "struct<" + ",".join(f"{f}:double" for f in FIELDS) + ">"
    odd = [(0, 300, (0.5, 0.5, 0.5, 0.0, 0.0, 1.0, float("nan"), 0.1)), (0, 301, None), (1, 302, (0.5, 0.5, 0.5, 0.0, 0.0, 1.0, 0.0, 0.0))]
    df = spark.createDataFrame(rows + odd, f"trial int, i int, body {kind}")
    want = set()
    known = [*rows, odd[2]]
    for n, (t, i, a) in enumerate(known):
        for u, j, b in known[n + 1 :]:
            if t == u and contact.gjk_distance_pair(a, b) <= 0.02:
                want.add((t, i, j))
    got = [(x.trial, x.i, x.j) for x in contacts(df, 0.02).collect()]
    assert len(got) == len(set(got))
    assert set(got) == want


def test_points_fill_as_groups_do(spark):
    points = sample_points(spark, 9, 8, 50)
    want = {r.trial: r.crit for r in critical_fill(points, 0.25).collect()}
    assert {r.trial: r.crit for r in point_fill(points, 0.25).collect()} == want
    assert any(want.values())
