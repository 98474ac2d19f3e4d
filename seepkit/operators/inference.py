"""Proportions with limits per group, joint correction, and the least filling that meets a target."""

from __future__ import annotations

from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seepkit.functions.inference import bonferroni, clopper_pearson, normal_quantile, wilson, z_value


def proportions(df: DataFrame, by: list[str], hit: Column) -> DataFrame:
    """by, k, n: rows that hit and rows, counted with map-side combining."""
    return df.groupBy(*by).agg(F.sum(F.when(hit, 1).otherwise(0)).alias("k"), F.count("*").alias("n"))


def with_wilson(counts: DataFrame, alpha: float = 0.05) -> DataFrame:
    limits = wilson(F.col("k"), F.col("n"), z_value(alpha))
    return counts.withColumn("w", limits).select("*", F.col("w.lo").alias("lo"), F.col("w.hi").alias("hi")).drop("w")


@lru_cache(8)
def _limits(side: str, gateway: int) -> Column:
    """The exact limits of three columns. Putting the expression together takes longer than some hundred rows."""
    return clopper_pearson(F.col("__k"), F.col("__n"), F.col("__alpha"), side)


def with_clopper_pearson(counts: DataFrame, alpha: float | Column = 0.05, side: str = "both") -> DataFrame:
    """counts, with k and n, and their exact limits lo and hi."""
    level = F.lit(float(alpha)) if isinstance(alpha, float) else alpha
    asked = counts.withColumns({"__k": F.col("k"), "__n": F.col("n"), "__alpha": level})
    found = asked.withColumn("__c", _limits(side, id(SparkContext._gateway)))
    return found.select(*counts.columns, F.col("__c.lo").alias("lo"), F.col("__c.hi").alias("hi"))


def with_bonferroni(counts: DataFrame, alpha: float, m: int | None = None) -> DataFrame:
    """Wilson limits that hold jointly for m groups at level alpha; by default for all of ``counts``,
    few rows by nature, which a window counts in the same pass."""
    if m is not None:
        made = with_wilson(counts, alpha / max(1, m))
        return made.withColumn("alpha_each", bonferroni(alpha, max(1, m)))
    level = bonferroni(alpha, F.count("*").over(Window.partitionBy(F.lit(0))))
    limits = wilson(F.col("k"), F.col("n"), normal_quantile(1 - F.col("alpha_each") / 2))
    return counts.withColumn("alpha_each", level).withColumn("w", limits).select(*counts.columns, F.col("w.lo").alias("lo"), F.col("w.hi").alias("hi"), "alpha_each")


def min_fill(curve: DataFrame, target: float, alpha: float = 0.05, joint: bool = True) -> DataFrame:
    """One row: the least n_fill whose one-sided exact lower bound reaches the target, or null.

    curve: n_fill, k, trials, a row a candidate filling. ``joint`` divides alpha by the number of
    candidates, since the least is picked after looking at all; they are few, by design of the curve, so
    a window counts them in one pass over it.
    """
    level = F.lit(alpha) / F.count("*").over(Window.partitionBy(F.lit(0))) if joint else F.lit(alpha)
    counts = curve.select("n_fill", "k", F.col("trials").alias("n"), level.alias("level"))
    return with_clopper_pearson(counts, F.col("level"), "lower").agg(F.min(F.when(F.col("lo") >= target, F.col("n_fill"))).alias("n_fill"))
