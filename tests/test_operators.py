import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seepkit.functions.inference import clopper_pearson_limits
from seepkit.functions.rng import u01
from seepkit.operators import optimise, percolation
from seepkit.operators.connectivity import NotConverged, components
from seepkit.operators.inference import min_fill, with_clopper_pearson, with_wilson
from seepkit.plans.steps import GateFailed, agreement, digest, freeze, gate, run_steps, thaw


def least(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


@pytest.mark.parametrize("edges", [
    [],
    [(1, 1)],
    [(i, i + 1) for i in range(60)],
    [(0, i) for i in range(1, 40)] + [(100, 101), (101, 100), (100, 101)],
    [tuple(random.Random(i).sample(range(200), 2)) for i in range(150)],
])
def test_components(spark, edges):
    df = spark.createDataFrame(edges + [(None, 5)], "src long, dst long") if edges else spark.createDataFrame([], "src long, dst long")
    assert {r.node: r.comp for r in components(df).collect()} == least(edges)


def test_components_of_stars(spark, monkeypatch):
    """Whatever a task joins at a time, and for names as nodes."""
    from seepkit.operators import connectivity

    monkeypatch.setattr(connectivity, "LOCAL", 7)
    r = random.Random(1)
    edges = [tuple(f"n{x}" for x in r.sample(range(150), 2)) for _ in range(120)] + [("n7", "n7"), ("z", "z")]
    df = spark.createDataFrame(edges, "src string, dst string").repartition(5)
    assert {x.node: x.comp for x in components(df).collect()} == least(edges)


def test_components_that_tasks_found_take_one_round(spark, monkeypatch):
    """Stars that a task made whole are known as such: one round confirms them."""
    from seepkit.operators import connectivity

    names, staged = [], connectivity.saved_with
    monkeypatch.setattr(connectivity, "saved_with", lambda df, name, **m: names.append(name) or staged(df, name, **m))
    got = components(spark.createDataFrame([(i, i + 1) for i in range(0, 90) if i % 30 != 29], "src long, dst long").coalesce(1))
    assert {(r.node, r.comp) for r in got.collect()} == {(i, i // 30 * 30) for i in range(90)}
    assert names.count("stars") == 1


def test_point_contacts_equal_all_pairs(spark):
    r = random.Random(4)
    rows = [(t, i, r.random(), r.random()) for t in (0, 1) for i in range(60)] + [(1, 60, 0.5, 0.5), (1, 61, 0.5, 0.5)]
    want = sorted((t, i, j) for t, i, x, y in rows for s, j, p, q in rows if s == t and i < j and (x - p) ** 2 + (y - q) ** 2 <= 0.04)
    got = percolation.point_contacts(spark.createDataFrame(rows, "trial long, i int, x double, y double"), 0.2).collect()
    assert sorted(tuple(x) for x in got) == want


def test_components_say_when_rounds_run_out(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(60)], "src long, dst long")
    with pytest.raises(NotConverged):
        components(df, most_rounds=2)


def test_shared_folder_is_asked_for_off_local_mode():
    from types import SimpleNamespace

    from seepkit.sources import shared

    def session(master, found=None):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: found or d), sparkContext=SimpleNamespace(master=master))

    assert shared.shared_dir(session("local[8]")) == shared.LOCAL_DEFAULT
    assert shared.shared_dir(session("spark://x:7077", "hdfs://y/z/")) == "hdfs://y/z"
    for master in ("spark://x:7077", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared.shared_dir(session(master))


def test_uniforms_ignore_partitions(spark):
    a, b = (spark.range(0, 500, 1, p).select("id", u01(1, "id").alias("u")).orderBy("id").collect() for p in (1, 7))
    assert a == b
    assert 0.4 < sum(r.u for r in a) / 500 < 0.6


def test_exact_limits():
    assert clopper_pearson_limits(0, 10, 0.05)[0] == 0
    assert clopper_pearson_limits(0, 10, 0.05)[1] == pytest.approx(1 - 0.025**0.1, abs=1e-12)
    assert clopper_pearson_limits(10, 10, 0.05) == (pytest.approx(0.025**0.1, abs=1e-12), 1.0)
    assert clopper_pearson_limits(8, 10, 0.05) == (pytest.approx(0.44390, abs=1e-5), pytest.approx(0.97479, abs=1e-5))
    assert clopper_pearson_limits(50_000, 100_000, 0.05)[0] == pytest.approx(0.4969, abs=1e-4)


@pytest.mark.parametrize("side", ["both", "lower", "upper"])
def test_limits_in_the_jvm_equal_bisection(spark, side):
    rows = [(k, n) for n in (1, 2, 7, 60, 1001) for k in sorted({0, 1, n // 3, n // 2, n - 1, n})] + [(1, 10**5), (10, 10**7), (5 * 10**6, 10**7), (10**7 - 3, 10**7)]
    df = with_clopper_pearson(spark.createDataFrame(rows, "k long, n long"), 0.03, side)
    assert not any(x in df._jdf.queryExecution().toString() for x in ("Python", "Pandas", "Arrow"))
    for r in df.collect():
        assert (r.lo, r.hi) == pytest.approx(clopper_pearson_limits(r.k, r.n, 0.03, side), abs=1e-11)


def test_limits_where_the_density_underflows(spark):
    """Newton's first step for 1,490 of 1,500 starts so far out that the density is 0 there."""
    rows = [(1490, 1500), (10, 1500), (1499, 1500), (2995, 3000)]
    for side, alpha in (("lower", 0.05 / 7), ("both", 1e-6)):
        for r in with_clopper_pearson(spark.createDataFrame(rows, "k long, n long"), alpha, side).collect():
            assert (r.lo, r.hi) == pytest.approx(clopper_pearson_limits(r.k, r.n, alpha, side), abs=1e-11)


def test_normal_quantiles(spark):
    from statistics import NormalDist

    from seepkit.functions.inference import normal_quantile

    for r in spark.createDataFrame([(0.5,), (0.6,), (0.975,), (0.99999,)], "p double").select("p", normal_quantile(F.col("p")).alias("z")).collect():
        assert r.z == pytest.approx(NormalDist().inv_cdf(r.p), abs=1e-10)


def test_limits_of_nothing(spark):
    df = spark.createDataFrame([(0, 0), (None, None)], "k long, n long")
    assert all(r.lo is None for r in with_wilson(df).collect() + with_clopper_pearson(df).collect())


def test_min_fill_may_not_exist(spark):
    curve = spark.createDataFrame([(1, 0, 50), (2, 30, 50), (3, 50, 50)], "n_fill long, k long, trials long")
    assert min_fill(curve, 0.5).first().n_fill == 3
    assert min_fill(curve, 0.999).first().n_fill is None


def test_fronts_keep_ties(spark):
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate([(1, 1), (1, 1), (2, 3), (2, 2), (3, 3), (4, 5)])] + [(9, None, 1.0)]
    df = spark.createDataFrame(rows, "id int, x double, y double")
    want = {0, 1, 2, 5}
    assert {r.id for r in optimise.pareto_2d(df, "x", "y").collect()} == want
    assert {r.id for r in optimise.pareto_kd(df, ["x"], ["y"]).collect()} == want
    assert optimise.pareto_2d(df.limit(0), "x", "y").count() == 0


@pytest.mark.parametrize("held", [20, 10**6])
def test_fronts_equal_brute_force(spark, monkeypatch, held):
    monkeypatch.setattr(optimise, "HELD", held)
    monkeypatch.setattr(optimise, "RANGE", held)
    r = random.Random(5)
    rows = [(i, float(r.randint(0, 12)), r.randint(0, 12), r.random()) for i in range(800)] + [(900, None, 1, 0.0)]
    df = spark.createDataFrame(rows, "id int, a double, b int, c double").repartition(9)

    def beats(x, y, signs):
        d = [(u - v) * s for u, v, s in zip(x, y, signs, strict=True)]
        return all(t <= 0 for t in d) and any(t < 0 for t in d)

    known = rows[:-1]
    want = {x[0] for x in known if not any(beats(y[1:], x[1:], (1, -1, 1)) for y in known)}
    assert {x.id for x in optimise.pareto_kd(df, ["a", "c"], ["b"]).collect()} == want
    flat = {x[0] for x in known if not any(beats(y[1:3], x[1:3], (1, -1)) for y in known)}
    assert {x.id for x in optimise.pareto_2d(df, "a", "b").collect()} == flat
    assert optimise.pareto_kd(df.limit(0), ["a"], ["b"]).count() == 0
    assert optimise.pareto_2d(df.select("id", "a", F.lit(3).alias("b")), "b", "a").count() == sum(x[1] == 12 for x in known)


def test_joint_limits_count_their_statements(spark):
    from seepkit.operators.inference import with_bonferroni

    df = spark.createDataFrame([(1, 10), (2, 10), (3, 10), (4, 10)], "k long, n long")
    assert {r.alpha_each for r in with_bonferroni(df, 0.04).collect()} == {0.01}


def test_integer_scan(spark):
    got = {(r.x1, r.x2) for r in optimise.int_scan(spark, [2.0, 3.0], 7.0).collect()}
    assert got == {(a, b) for a in range(9) for b in range(9) if 2 * a + 3 * b <= 7}
    assert optimise.min_cost(optimise.int_scan(spark, [2.0, 3.0], 7.0), F.col("x1") > 9, ["x1"]).count() == 0


def test_prefixes_never_lose_a_span(spark):
    points = percolation.sample_points(spark, 3, 12, 60)
    crit = percolation.critical_fill(points, 0.3)
    curve = percolation.percolation_curve(crit, [10, 20, 40, 60]).orderBy("n_fill").collect()
    assert [r.k for r in curve] == sorted(r.k for r in curve)
    shorter = {r.trial: r.crit for r in percolation.critical_fill(percolation.prefix(points, 40), 0.3).collect()}
    assert all(shorter[r.trial] == (r.crit if r.crit and r.crit <= 40 else None) for r in crit.collect())
    assert percolation.sample_cylinders(spark, 1, 2, 5).count() == 10


def test_gates_and_frozen_results(spark, tmp_path):
    df = spark.range(10)
    assert gate("g", df, small=F.col("id") < 10).count() == 10
    with pytest.raises(GateFailed):
        gate("g", df, small=F.col("id") < 9)
    mark = freeze(df, str(tmp_path / "a"))
    assert thaw(spark, str(tmp_path / "a"), mark).count() == 10
    with pytest.raises(GateFailed):
        thaw(spark, str(tmp_path / "a"), (10, 1, 2))


def test_digests_see_nulls_and_cells(spark):
    rows = [[("a", None), ("b", "c")], [("a", ""), ("b", "c")], [("a", "b"), (None, "c")], [("ab", None), ("", "bc")]]
    made = [digest(spark.createDataFrame(x, "x string, y string")) for x in rows]
    assert len(set(made)) == len(rows)
    assert digest(spark.createDataFrame(rows[0][::-1], "x string, y string").repartition(3)) == made[0]
    assert digest(spark.createDataFrame([], "x string, y string")) == (0, 0, 0)


def test_agreement(spark):
    one = spark.createDataFrame([(1, "a", None), (2, "b", 1), (3, "c", 1), (4, None, None)], "k int, x string, y int")
    two = spark.createDataFrame([(None, 1, "a"), (2, 2, "b"), (None, 4, None), (1, 5, "e")], "y int, k int, x string")
    assert {r.k: r.agree for r in agreement(one, two, ["k"]).collect()} == {1: True, 2: False, 3: False, 4: True, 5: False}
    assert agreement(one.limit(0), two.limit(0), ["k"]).count() == 0


def test_steps(spark, tmp_path, capsys):
    sf = "/root/testdata/sf0.001"
    assert list(run_steps(spark, sf, 4, 4, out=str(tmp_path))) == ["pareto_part"]
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("dry", "dry")
    planned = run_steps(spark, sf, 1, 4, dry_run=True, out=str(tmp_path / "none"))
    assert list(planned) == ["contact_pairs", "percolation_curve", "min_fill", "pareto_part"]
    # reading a table's schema is a job; no query's own job starts
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("dry") for s in tracker.getJobInfo(j).stageIds]
    assert all(s.name.startswith("parquet at") for s in stages if s)
    planned["pareto_part"].collect()
    assert len(tracker.getJobIdsForGroup("dry")) > len(stages)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert not (tmp_path / "none").exists()
    with pytest.raises(ValueError):
        run_steps(spark, sf, 3, 9)


def _unbeaten(v):
    return {tuple(x) for x in v if not ((v <= x).all(1) & (v < x).any(1)).any()}


@pytest.mark.parametrize("kind", ["correlated", "anticorrelated", "ties"])
def test_fronts_over_cells(spark, monkeypatch, kind):
    """Fronts of few and of nearly all points; no join without keys, no single task."""
    monkeypatch.setattr(optimise, "HELD", 64)
    r = np.random.default_rng(3)
    base = r.random((1500, 1))
    v = {"correlated": base + 0.05 * r.random((1500, 3)), "anticorrelated": r.dirichlet([1, 1, 1], 1500), "ties": r.integers(0, 9, (1500, 3)) / 8}[kind]
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(v)], "o0 int, a double, b double, c double").repartition(6)
    front = optimise.pareto_kd(df, ["a", "b", "c"])
    want = _unbeaten(v)
    got = front.collect()
    assert {(x.a, x.b, x.c) for x in got} == want
    assert len(got) == sum(tuple(x) in want for x in v)
    plans = []
    saved = optimise.saved

    def watched(plan, name):
        plans.append(plan._jdf.queryExecution().toString())
        return saved(plan, name)

    monkeypatch.setattr(optimise, "saved", watched)
    optimise.pareto_kd(df, ["a", "b", "c"]).collect()
    assert plans
    assert not any(x in p for p in plans for x in ("NestedLoop", "CartesianProduct", "SinglePartition", "Coalesce 1"))


def test_ranges_follow_the_abscissas(spark):
    """A heavy tail: equal widths would put nearly all in one range."""
    r = np.random.default_rng(4)
    x = (1 - r.random(40_000)) ** -2.0
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    cuts = optimise.splitters(df, "x", 40)
    sizes = sorted(z["count"] for z in df.groupBy(optimise.part_of(F.col("x"), cuts).alias("part")).count().collect())
    assert len(sizes) == 40
    assert sizes[-1] <= 4 * sizes[len(sizes) // 2]
    want = np.searchsorted(cuts, x, "right")
    assert [z[0] for z in df.select(optimise.part_of(F.col("x"), cuts)).collect()] == want.tolist()
    assert optimise.splitters(df.limit(0), "x", 8) == []
