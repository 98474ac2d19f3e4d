"""Column names that don't clash with those of a caller's table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def named(column: str) -> Column:
    """The column of exactly this name, dots and spaces included."""
    return F.col("`" + column.replace("`", "``") + "`")


def unused(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, each with as many underscores before it as set it apart from the table's columns
    (Spark's names ignore case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def folded(df: DataFrame, text: str) -> DataFrame:
    """Two columns: ``row``, a struct of all columns but the text, and ``text``; ``unfolded`` undoes it.

    Whatever the columns are called, they can't clash with what an operator adds in between.
    """
    others = [c for c in df.columns if c != text]
    row = F.struct(*(named(c).alias(f"c{i}") for i, c in enumerate(others))) if others else F.struct(F.lit(0).alias("c"))
    return df.select(row.alias("row"), named(text).alias("text"))


def unfolded(df: DataFrame, columns: list[str], text: str, *replaced: str) -> list[Column]:
    """The former columns in order, but for those with a name of ``replaced``, from a table that still
    has ``row`` and, if it is among the columns, ``text``."""
    places = {c: i for i, c in enumerate(x for x in columns if x != text)}
    gone = {c.lower() for c in replaced}
    return [df["text"].alias(c) if c == text else df["row"][f"c{places[c]}"].alias(c) for c in columns if c.lower() not in gone]
