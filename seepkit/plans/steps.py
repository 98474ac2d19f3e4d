"""Stepped runs, dry runs, audits, gates and frozen results."""

from __future__ import annotations

import argparse
import json
import sys
import uuid
from collections.abc import Callable, Sequence
from contextlib import nullcontext
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from seepkit.sources.shared import delete, planning, read_text, write_observed, write_text


class GateFailed(AssertionError):
    """A stage's result breaks a check."""


def audit(df: DataFrame, **checks: Column) -> DataFrame:
    """One row per check: name, rows and the rows that break it, in one pass."""
    broken = [F.count(F.when(~F.coalesce(c, F.lit(False)), 1)).alias(k) for k, c in checks.items()]
    pairs = ", ".join(f"'{k}', `{k}`" for k in checks)
    return df.agg(F.count("*").alias("rows"), *broken).select("rows", F.expr(f"stack({len(checks)}, {pairs}) AS (check, broken)")).select("check", "rows", "broken")


def gate(name: str, df: DataFrame, **checks: Column) -> DataFrame:
    """``df`` itself, once every check holds for all its rows; else GateFailed."""
    bad = [r["check"] for r in audit(df, **checks).collect() if r["broken"]]
    if bad:
        raise GateFailed(f"{name}: {', '.join(bad)}")
    return df


def marks(df: DataFrame) -> list[Column]:
    """Aggregates of a table: rows, and two order-free sums of the first and next 32 bits of the rows' md5,
    over the cells' text (a null is the character U+0002 alone) with U+001F between them."""
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x02")) for c in df.columns]
    row = F.md5(F.concat_ws("\x1f", *cells))
    sums = [F.coalesce(F.sum(F.conv(F.substring(row, at, 8), 16, 10).cast("long")), F.lit(0)) for at in (1, 9)]
    return [F.count("*").alias("rows"), sums[0].alias("mark1"), sums[1].alias("mark2")]


def digest(df: DataFrame) -> tuple[int, int, int]:
    """Rows, and two order-free sums of their hashes."""
    return tuple(df.agg(*marks(df)).first())


def gated(name: str, df: DataFrame, path: str, **checks: Column) -> DataFrame:
    """``df`` written to ``path`` and read again, if every check holds for all rows written; else the folder is
    deleted and GateFailed raised. The checks are counted while the rows are written: one job."""
    broken = {k: F.count_if(~F.coalesce(c, F.lit(False))) for k, c in checks.items()}
    bad = [k for k, n in write_observed(df, path, **broken).items() if n]
    if bad:
        delete(df.sparkSession, path)
        raise GateFailed(f"{name}: {', '.join(bad)}")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _metrics(df: DataFrame) -> dict[str, Column]:
    return dict(zip(("rows", "mark1", "mark2"), marks(df), strict=True))


def freeze(df: DataFrame, path: str) -> tuple[int, int, int]:
    """Write the result as Parquet and return the digest of the rows, taken while they were written."""
    found = write_observed(df, path, **_metrics(df))
    return found["rows"], found["mark1"], found["mark2"]


def thaw(spark: SparkSession, path: str, expected: tuple[int, int, int]) -> DataFrame:
    df = spark.read.parquet(path)
    if digest(df) != tuple(expected):
        raise GateFailed(f"{path} isn't what was frozen")
    return df


def agreement(one: DataFrame, two: DataFrame, keys: list[str]) -> DataFrame:
    """keys and ``agree``: whether two independent results both have a row of these keys, with equal cells.

    Null cells are equal to each other; a key that one side lacks, or that either has with several
    cells, doesn't agree throughout.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        rest = [c for c in sorted(df.columns) if c not in keys]
        return df.select(*keys, F.struct(F.lit(1).alias("there"), *rest).alias(name))

    joined = side(one, "__one").join(side(two, "__two"), keys, "full")
    agree = F.coalesce(F.col("__one").eqNullSafe(F.col("__two")) & F.col("__one").isNotNull(), F.lit(False))
    return joined.select(*keys, agree.alias("agree"))


@dataclass(frozen=True)
class Step:
    """A named table: ``make(spark, sf_dir, inputs)`` from the tables of a folder and the results of the steps it
    ``needs``; ``checks`` must hold for all its rows."""

    name: str
    make: Callable[[SparkSession, str, dict[str, DataFrame]], DataFrame]
    needs: tuple[str, ...] = ()
    checks: dict[str, Column] | Callable[[], dict[str, Column]] = field(default_factory=dict)


def _query(name: str) -> Step:
    def make(spark: SparkSession, sf_dir: str, inputs: dict[str, DataFrame]) -> DataFrame:
        from seepkit.plans.catalog import QUERIES

        return QUERIES[name](spark, sf_dir)

    return Step(name, make)


STEPS = ("contact_pairs", "percolation_curve", "min_fill", "pareto_part")


def _manifest(out: str, name: str) -> str:
    return f"{out}/{name}.json"


def store(spark: SparkSession, out: str, step: Step, df: DataFrame, inputs: dict[str, list[int]]) -> dict:
    """Write a step's result and, last, its manifest: table, digest, and the digests of what it was made from.
    Rows, digest and checks are taken in the job that writes. Only a finished step has a manifest that names
    its table, so what a broken run leaves is never read."""
    path = f"{out}/{step.name}-{uuid.uuid4().hex[:12]}"
    checks = step.checks() if callable(step.checks) else step.checks
    broken = {f"check {k}": F.count_if(~F.coalesce(c, F.lit(False))) for k, c in checks.items()}
    found = write_observed(df, path, **_metrics(df), **broken)
    bad = [k[6:] for k, n in found.items() if k.startswith("check ") and n]
    if bad:
        delete(spark, path)
        raise GateFailed(f"{step.name}: {', '.join(bad)}")
    made = {"step": step.name, "table": path, "digest": [found["rows"], found["mark1"], found["mark2"]], "schema": df.schema.json(), "needs": inputs}
    write_text(spark, _manifest(out, step.name), json.dumps(made, indent=1))
    return made


def stored(spark: SparkSession, out: str, name: str) -> tuple[DataFrame, dict]:
    """A step's result, if its manifest is there, its rows are those that were stored, and the steps that it was
    made from haven't been stored anew since; else GateFailed."""
    text = read_text(spark, _manifest(out, name))
    if text is None:
        raise GateFailed(f"{out} has no finished result of step {name}")
    made = json.loads(text)
    for need, digest_of in made["needs"].items():
        now = read_text(spark, _manifest(out, need))
        if now is None or json.loads(now)["digest"] != digest_of:
            raise GateFailed(f"{name} was made from another result of step {need}")
    try:
        df = spark.read.schema(StructType.fromJson(json.loads(made["schema"]))).parquet(made["table"])
        same = list(digest(df)) == made["digest"]
    except Exception as e:
        raise GateFailed(f"{made['table']} can't be read") from e
    if not same:
        raise GateFailed(f"{made['table']} isn't what was stored")
    return df, made


def run_steps(spark: SparkSession, sf_dir: str, first: int = 1, last: int = 4, dry_run: bool = False, out: str | None = None, steps: Sequence[Step | str] = STEPS) -> dict[str, DataFrame]:
    """Steps first..last of a list, by default contact, percolation, limits and optimisation.

    A dry run plans them, and the steps they need, and starts no job. With ``out`` each result is stored
    there and read again, and steps before the first that later ones need are read from there, not run.
    """
    steps = [_query(s) if isinstance(s, str) else s for s in steps]
    if not 1 <= first <= last <= len(steps):
        raise ValueError(f"steps run from 1 to {len(steps)}")
    made: dict[str, DataFrame] = {}
    digests: dict[str, list[int]] = {}
    by_name = {s.name: s for s in steps}

    def given(name: str) -> DataFrame:
        if name not in made:
            if out and not dry_run:
                made[name], about = stored(spark, out, name)
                digests[name] = about["digest"]
            else:
                made[name] = by_name[name].make(spark, sf_dir, {n: given(n) for n in by_name[name].needs})
        return made[name]

    for step in steps[first - 1 : last]:
        with planning() if dry_run else nullcontext():
            df = step.make(spark, sf_dir, {n: given(n) for n in step.needs})
        if out and not dry_run:
            about = store(spark, out, step, df, {n: digests[n] for n in step.needs})
            digests[step.name] = about["digest"]
            df = spark.read.schema(df.schema).parquet(about["table"])
        made[step.name] = df
    return {s.name: made[s.name] for s in steps[first - 1 : last]}


def main(args: list[str]) -> None:
    p = argparse.ArgumentParser()
    p.add_argument("sf_dir")
    p.add_argument("--from-step", type=int, default=1)
    p.add_argument("--to-step", type=int, default=4)
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--out")
    a = p.parse_args(args)
    from seepkit.plans.catalog import CYLINDER_STEPS

    spark = SparkSession.builder.getOrCreate()
    for name, df in run_steps(spark, a.sf_dir, a.from_step, a.to_step, a.dry_run, a.out, CYLINDER_STEPS).items():
        if a.dry_run:
            df.explain("formatted")
        else:
            print(name, digest(df))


if __name__ == "__main__":
    main(sys.argv[1:])
