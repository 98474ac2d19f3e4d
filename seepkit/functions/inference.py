"""Binomial confidence limits: Wilson as expressions, Clopper-Pearson by bisection, Bonferroni."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def z_value(alpha: float, two_sided: bool = True) -> float:
    return NormalDist().inv_cdf(1 - alpha / (2 if two_sided else 1))


def wilson(k: Column, n: Column, z: float | Column) -> Column:
    """Score interval, struct<lo, hi>; null where n is 0."""
    z = F.lit(z) if isinstance(z, float) else z
    n = F.when(n > 0, n.cast("double"))
    p = k / n
    middle, scale = p + z * z / (2 * n), 1 + z * z / n
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.struct(((middle - half) / scale).alias("lo"), ((middle + half) / scale).alias("hi"))


def normal_quantile(share: Column) -> Column:
    """z with a share of 1/2 <= share < 1 of the normal distribution below it, by Newton's steps on its
    density's series: 0.5 + phi(z) * (z + z^3/3 + z^5/15 + ...)."""

    def below(z: Column) -> Column:
        def add(s: Column, i: Column) -> Column:
            return _let({"t": s["t"] * z * z / (2 * i + 1)}, lambda w: F.struct(w["t"].alias("t"), (s["sum"] + w["t"]).alias("sum")))

        sums = F.aggregate(F.sequence(F.lit(1), F.lit(120)), F.struct(z.alias("t"), z.alias("sum")), add)["sum"]
        return _let({"phi": F.exp(-z * z / 2) / math.sqrt(2 * math.pi), "sum": sums}, lambda w: F.struct((0.5 + w["phi"] * w["sum"]).alias("below"), w["phi"].alias("phi")))

    # the distribution is concave here: steps from 0 stay below the quantile and come nearer
    return F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.lit(0.0), lambda z, _: _let({"z": z, "f": below(z)}, lambda w: w["z"] + (share - w["f"]["below"]) / w["f"]["phi"]))


def bonferroni(alpha: float, m: Column | int) -> Column:
    """The level at which each of m joint statements is made."""
    return F.lit(alpha) / m


@lru_cache(100_000)
def tail(k: int, n: int, p: float) -> float:
    """P(X >= k) for a binomial X; terms from the larger side are summed for accuracy."""
    if k <= 0:
        return 1.0
    if k > n or p <= 0:
        return 0.0
    if p >= 1:
        return 1.0
    lp, lq = math.log(p), math.log1p(-p)
    top = math.lgamma(n + 1)

    def term(i: int) -> float:
        return math.exp(top - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * lp + (n - i) * lq)

    if k > n * p:  # terms fall from k on
        total, i, t = 0.0, k, term(k)
        while i <= n and t > total * 1e-18:
            total += t
            t *= (n - i) / (i + 1) * p / (1 - p)
            i += 1
        return total
    total, i, t = 0.0, k - 1, term(k - 1)
    while i >= 0 and t > total * 1e-18:
        total += t
        t *= i / (n - i + 1) * (1 - p) / p
        i -= 1
    return 1.0 - total


@lru_cache(100_000)
def clopper_pearson_limits(k: int, n: int, alpha: float, side: str = "both") -> tuple[float, float]:
    """Exact limits; side: both, lower or upper (the other limit is then 0 or 1)."""
    a = alpha / 2 if side == "both" else alpha

    def solve(above) -> float:
        lo, hi = 0.0, 1.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if above(mid) else (mid, hi)
        return (lo + hi) / 2

    low = 0.0 if k == 0 or side == "upper" else solve(lambda p: tail(k, n, p) >= a)
    high = 1.0 if k == n or side == "lower" else solve(lambda p: 1 - tail(k + 1, n, p) <= a)
    return low, high


#: Steps to a limit, at most, and the relative step from which none follows.
STEPS, SETTLED = 80, 1e-14
#: Terms of the series for the error of Stirling's formula: 1/12, -1/360, ... over odd powers (fixed values).
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360)


def _let(values: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """body of a struct of the values, each computed once."""
    return F.transform(F.array(F.struct(*(v.alias(k) for k, v in values.items()))), body)[0]


def stirling_error(z: Column) -> Column:
    """ln Gamma(z) less Stirling's formula, for z >= 1: the series from 16 on, the recurrence below."""

    def series(v: Column) -> Column:
        inverse = 1 / v["z"]
        made = F.lit(0.0)
        for c in reversed(STIRLING):
            made = made * inverse * inverse + c
        below = F.aggregate(F.sequence(F.lit(0), F.lit(15)), F.lit(0.0), lambda s, i: s + (v["at"] + i + 0.5) * F.log1p(1 / (v["at"] + i)) - 1)
        return made * inverse + F.when(v["z"] > v["at"], below).otherwise(0.0)

    return _let({"at": z, "z": F.when(z >= 16, z).otherwise(z + 16)}, series)


def beta_cdf(x: Column, a: Column, b: Column, log_scale: Column) -> Column:
    """struct<below, density>: the regularised incomplete beta function and its derivative at 0 < x < 1, by the
    continued fraction, on the side where it converges fast. ``log_scale``: see ``_log_scale``."""

    def sided(v: Column) -> Column:
        other = v["x"] >= (v["a"] + 1) / (v["a"] + v["b"] + 2)
        swap = lambda p, q: F.when(other, q).otherwise(p)
        logs = v["a"] * F.log(v["x"] * (v["a"] + v["b"]) / v["a"]) + v["b"] * F.log((1 - v["x"]) * (v["a"] + v["b"]) / v["b"]) + v["s"]
        return _let({"other": other, "a": swap(v["a"], v["b"]), "b": swap(v["b"], v["a"]), "x": swap(v["x"], 1 - v["x"]), "power": F.exp(logs), "at": v["x"]}, fraction)

    def fraction(v: Column) -> Column:
        a, b, x = v["a"], v["b"], v["x"]
        tiny = lambda c: F.when(F.abs(c) < 1e-300, 1e-300).otherwise(c)

        def term(s: Column, m: Column) -> Column:
            even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            first = lambda w: _let({"d": 1 / tiny(1 + w["even"] * w["d"]), "c": tiny(1 + w["even"] / w["c"]), "h": w["h"], "odd": w["odd"]}, second)
            second = lambda w: _let({"d": 1 / tiny(1 + w["odd"] * w["d"]), "c": tiny(1 + w["odd"] / w["c"]), "h": w["h"] * w["d"] * w["c"]}, lambda u: F.struct(u["c"].alias("c"), u["d"].alias("d"), (u["h"] * u["d"] * u["c"]).alias("h"), (F.abs(u["d"] * u["c"] - 1) < 1e-16).alias("done")))
            return F.when(s["done"], s).otherwise(_let({"even": even, "odd": odd, "c": s["c"], "d": s["d"], "h": s["h"]}, first))

        start = 1 / tiny(1 - (a + b) * x / (a + 1))
        begin = _let({"d": start}, lambda w: F.struct(F.lit(1.0).alias("c"), w["d"].alias("d"), w["d"].alias("h"), F.lit(False).alias("done")))
        terms = F.sequence(F.lit(1), (20 + 6 * F.sqrt(F.greatest(a, b))).cast("int"))
        sums = F.aggregate(terms, begin, lambda s, m: term(s, m.cast("double")))
        return _let({"h": sums["h"], "other": v["other"], "a": a, "power": v["power"], "at": v["at"]}, lambda w: F.struct(F.when(w["other"], 1 - w["power"] * w["h"] / w["a"]).otherwise(w["power"] * w["h"] / w["a"]).alias("below"), (w["power"] / (w["at"] * (1 - w["at"]))).alias("density")))

    return _let({"x": x, "a": a, "b": b, "s": log_scale}, sided)


def _log_scale(a: Column, b: Column) -> Column:
    """What is left of ln(x^a (1-x)^b / B(a, b)) beside deviances, which don't cancel however large a and b are."""
    return 0.5 * F.log(a * b / (2 * math.pi * (a + b))) + stirling_error(a + b) - stirling_error(a) - stirling_error(b)


def beta_quantile(share: Column, a: Column, b: Column) -> Column:
    """x with a share of the beta distribution below it: Newton's steps within a bracket that every step
    narrows; halving where a step would leave it."""

    def step(s: Column, _: Column) -> Column:
        return F.when(s["done"], s).otherwise(_let({"f": beta_cdf(s["x"], s["a"], s["b"], s["scale"]), **{k: s[k] for k in ("x", "lo", "hi", "share", "a", "b", "scale")}}, bracket))

    def bracket(v: Column) -> Column:
        high = v["f"]["below"] >= v["share"]
        newton = F.when(v["f"]["density"] > 0, v["x"] - (v["f"]["below"] - v["share"]) / v["f"]["density"])  # a null, far out where the density underflows, is not inside
        return _let({"lo": F.when(high, v["lo"]).otherwise(v["x"]), "hi": F.when(high, v["x"]).otherwise(v["hi"]), "to": newton, **{k: v[k] for k in ("x", "share", "a", "b", "scale")}}, moved)

    def moved(v: Column) -> Column:
        inside = (v["to"] > v["lo"]) & (v["to"] < v["hi"])
        x = F.when(inside, v["to"]).otherwise((v["lo"] + v["hi"]) / 2)
        return _let({"x": x, "was": v["x"], **{k: v[k] for k in ("lo", "hi", "share", "a", "b", "scale")}}, lambda w: F.struct(*(w[k].alias(k) for k in ("x", "lo", "hi", "share", "a", "b", "scale")), (F.abs(w["x"] - w["was"]) <= SETTLED * w["x"]).alias("done")))

    values = {"x": a / (a + b), "lo": F.lit(0.0), "hi": F.lit(1.0), "share": share, "a": a, "b": b, "scale": _log_scale(a, b)}
    begin = F.struct(*(v.alias(k) for k, v in values.items()), F.lit(False).alias("done"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), begin, step)["x"]


def clopper_pearson(k: Column, n: Column, alpha: Column | float = 0.05, side: str = "both") -> Column:
    """Exact interval, struct<lo, hi>, by quantiles of the beta distribution in the JVM; null where n is null or 0.

    side: both, lower or upper (the other limit is then 0 or 1). The work for a row grows with the root of
    n; ``tail`` and ``clopper_pearson_limits`` are its check in plain Python.
    """
    a = (F.lit(alpha) if isinstance(alpha, float) else alpha) / (2 if side == "both" else 1)
    k, n = k.cast("double"), n.cast("double")
    low = F.struct(a.alias("share"), k.alias("a"), (n - k + 1).alias("b"), (k <= 0).alias("edge"), F.lit(0.0).alias("at"))
    high = F.struct((1 - a).alias("share"), (k + 1).alias("a"), (n - k).alias("b"), (k >= n).alias("edge"), F.lit(1.0).alias("at"))
    asked = F.array(*([low] if side != "upper" else []), *([high] if side != "lower" else []))
    found = F.transform(asked, lambda v: F.when(v["edge"], v["at"]).otherwise(beta_quantile(v["share"], v["a"], v["b"])))
    whole = {"both": found, "lower": F.concat(found, F.array(F.lit(1.0))), "upper": F.concat(F.array(F.lit(0.0)), found)}[side]
    known = F.when((n > 0) & k.isNotNull(), whole)
    return _let({"c": known}, lambda v: F.struct(v["c"][0].alias("lo"), v["c"][1].alias("hi")))
