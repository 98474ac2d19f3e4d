"""Reproducible uniforms: a pure function of seed and key, whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def u01(seed: int, *key: Column | str) -> Column:
    """Uniform in [0, 1) from the first 32 bits of md5("seed:key:key...")."""
    parts = [F.lit(f"{seed}")] + [(F.col(k) if isinstance(k, str) else k).cast("string") for k in key]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
