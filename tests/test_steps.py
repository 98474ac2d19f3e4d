import json
import os
import random
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from seepkit.operators import optimise
from seepkit.plans.steps import GateFailed, Step, freeze, gated, run_steps, stored
from seepkit.sources.shared import planning, read_text, saved, saved_with, write_text

RUNS: list[str] = []


def flow():
    def base(spark, sf_dir, inputs):
        RUNS.append("base")
        return spark.range(50).select("id", (F.col("id") % 7).alias("k"))

    def counts(spark, sf_dir, inputs):
        RUNS.append("counts")
        return inputs["base"].groupBy("k").agg(F.count("*").alias("n"))

    def total(spark, sf_dir, inputs):
        RUNS.append("total")
        return inputs["counts"].agg(F.sum("n").alias("total"))

    return [Step("base", base, checks={"small": F.col("id") < 50}), Step("counts", counts, ("base",), lambda: {"some": F.col("n") > 0}), Step("total", total, ("counts",))]


def test_steps_go_on_from_stored_results(spark, tmp_path):
    out, steps = str(tmp_path), flow()
    RUNS.clear()
    assert run_steps(spark, "", 1, 2, out=out, steps=steps)["counts"].count() == 7
    RUNS.clear()
    assert run_steps(spark, "", 3, 3, out=out, steps=steps)["total"].first().total == 50
    assert RUNS == ["total"]
    run_steps(spark, "", 1, 1, out=out, steps=[Step("base", lambda *_: spark.range(3).select("id", F.col("id").alias("k"))), *steps[1:]])
    with pytest.raises(GateFailed, match="another result of step base"):
        run_steps(spark, "", 3, 3, out=out, steps=steps)


def test_unfinished_and_damaged_results_are_refused(spark, tmp_path):
    out, steps = str(tmp_path), flow()
    with pytest.raises(GateFailed, match="no finished result of step counts"):
        run_steps(spark, "", 3, 3, out=out, steps=steps)
    run_steps(spark, "", 1, 2, out=out, steps=steps)
    _, about = stored(spark, out, "counts")
    spark.range(1).select(F.lit(0).cast("long").alias("k"), F.lit(5).cast("long").alias("n")).write.mode("append").parquet(about["table"])
    with pytest.raises(GateFailed, match="isn't what was stored"):
        run_steps(spark, "", 3, 3, out=out, steps=steps)
    write_text(spark, f"{out}/counts.json", json.dumps(about | {"table": f"{out}/gone"}))
    with pytest.raises(GateFailed, match="can't be read"):
        stored(spark, out, "counts")
    # a step that breaks off leaves the manifest of the last finished run
    before = read_text(spark, f"{out}/base.json")
    broken = Step("base", lambda s, d, i: spark.range(9).select(F.col("id"), F.raise_error(F.lit("broken")).cast("long").alias("k")))
    with pytest.raises(Exception, match="broken"):
        run_steps(spark, "", 1, 1, out=out, steps=[broken])
    assert read_text(spark, f"{out}/base.json") == before
    assert read_text(spark, f"{out}/never.json") is None


def jobs_of(spark, group, work):
    spark.sparkContext.setJobGroup(group, group)
    try:
        work()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_gates_are_counted_while_the_rows_are_written(spark, tmp_path):
    df = spark.range(0, 100, 1, 4)
    jobs = jobs_of(spark, "gate", lambda: gated("g", df, str(tmp_path / "a"), small=F.col("id") < 100, known=F.col("id").isNotNull()))
    assert jobs == jobs_of(spark, "plain", lambda: df.write.parquet(str(tmp_path / "plain"))) == 1
    assert spark.read.parquet(str(tmp_path / "a")).count() == 100
    with pytest.raises(GateFailed, match="g: small"):
        gated("g", df, str(tmp_path / "b"), small=F.col("id") < 99, known=F.col("id").isNotNull())
    assert not (tmp_path / "b").exists()
    assert gated("g", df.limit(0), str(tmp_path / "c"), small=F.col("id") < 0).count() == 0
    assert jobs_of(spark, "freeze", lambda: freeze(df, str(tmp_path / "d"))) == 1


def test_staged_tables_go_with_the_process(tmp_path):
    code = """
import sys
from pyspark.sql import SparkSession
from seepkit.sources.shared import discard, saved
spark = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').config('spark.checkpoint.dir', sys.argv[1]).getOrCreate()
a, b = saved(spark.range(3), 'a'), saved(spark.range(4), 'b')
discard(a)
import os
assert b.count() == 4 and sum(x.startswith('seepkit-') for x in os.listdir(sys.argv[1])) == 1
if sys.argv[2] == 'stop':
    spark.stop()
"""
    root = str(Path(__file__).resolve().parent.parent)
    for stop in ("stop", "run"):
        folder = tmp_path / stop
        folder.mkdir()
        made = subprocess.run([sys.executable, "-c", code, str(folder), stop], capture_output=True, text=True, check=False, env={**os.environ, "PYTHONPATH": root})
        assert made.returncode == 0, made.stderr
        assert not [x for x in os.listdir(folder) if x.startswith("seepkit-")]


def test_planning_stages_nothing(spark):
    df = spark.range(5)
    with planning():
        assert saved(df, "x") is df
        assert saved_with(df, "x", n=F.count("*"))[1]["n"] == 0
    made, seen = saved_with(df, "x", n=F.count("*"), top=F.max("id"))
    assert (made.count(), seen) == (5, {"n": 5, "top": 4})


@pytest.mark.parametrize("seed", range(6))
def test_shells_find_the_cheapest_design(spark, seed):
    r = random.Random(seed)
    costs, gains = [r.choice([0.5, 1.0, 1.25, 2.0, 3.1]) for _ in range(3)], [float(r.randint(0, 4)) for _ in range(3)]
    need, bound = r.randint(1, 25), r.choice([4.0, 30.0])
    every = [(round(sum(a * b for a, b in zip(x, costs, strict=True)), 9), x) for x in ((a, b, c) for a in range(61) for b in range(61) for c in range(61)) if sum(a * b for a, b in zip(x, gains, strict=True)) >= need]
    fit = [e for e in every if e[0] <= bound]
    df, took = optimise.cheapest_design(spark, costs, gains, need, bound)
    got = [(round(x.cost, 9), (x.x1, x.x2, x.x3)) for x in df.collect()]
    assert got == ([min(fit)] if fit else [])
    assert took["made"] <= 400  # of 226,981 tuples
    assert bool(took["made"]) == bool(fit)


def test_designs_that_cannot_be(spark):
    for costs in ([0.0, 1.0], [-1.0], []):
        with pytest.raises(ValueError, match="above 0"):
            optimise.cheapest_design(spark, costs, [1.0] * len(costs), 1, 9.0)
        with pytest.raises(ValueError, match="above 0"):
            optimise.int_scan(spark, costs, 9.0)
    assert optimise.cheapest_design(spark, [1.0], [1.0], None, 9.0)[0].count() == 0
    assert optimise.cheapest_design(spark, [1.0, 2.0], [0.0, 0.0], 3, 9.0)[0].count() == 0
    assert optimise.cheapest_design(spark, [1.0, 2.0], [1.0, 1.0], 0, 9.0)[0].first().cost == 0
