"""Student's t distribution as Columns: tail probability and quantile, without Python workers."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

_TINY = 1e-300
# Newton's steps from the normal quantile: where tails are heavy, each doubles t at first.
_NEWTON = 60


def log_gamma(x: Column) -> Column:
    """ln Gamma of a positive number: Stirling's series ten places further, brought back by recurrence."""
    y = x + 10
    product = x
    for i in range(1, 10):
        product = product * (x + i)
    square = y * y
    series = (1 / F.lit(12.0) - (1 / F.lit(360.0) - (1 / F.lit(1260.0) - 1 / (1680 * square)) / square) / square) / y
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - F.log(product)


def _fraction(a: Column, b: Column, x: Column, steps: Column) -> Column:
    """Continued fraction of the incomplete beta function, forwards, two levels a step."""
    start = F.struct(
        F.lit(1.0).alias("c"), (1 / (1 - (a + b) * x / (a + 1) + _TINY)).alias("d"),
        (1 / (1 - (a + b) * x / (a + 1) + _TINY)).alias("total"), x.alias("x"),
    )

    def step(s: Column, m: Column) -> Column:
        even = m * (b - m) * s["x"] / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * s["x"] / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + even * s["d"] + _TINY)
        c = 1 + even / s["c"] + _TINY
        last_d = 1 / (1 + odd * d + _TINY)
        last_c = 1 + odd / c + _TINY
        return F.struct(
            last_c.alias("c"), last_d.alias("d"), (s["total"] * d * c * last_d * last_c).alias("total"),
            s["x"].alias("x"),
        )

    levels = F.transform(F.sequence(F.lit(1), steps), lambda m: m.cast("double"))
    return F.aggregate(levels, start, step, lambda s: s["total"])


def two_sided_tail(t: Column, df: Column) -> Column:
    """P(|T| > |t|) for ``df`` degrees of freedom: the incomplete beta function at df / (df + t^2)."""
    a, b = df / 2, F.lit(0.5)
    x, rest = df / (df + t * t), t * t / (df + t * t)
    steps = (200 + 3 * F.sqrt(df)).cast("int")
    front = F.exp(log_gamma(a + b) - log_gamma(a) - math.lgamma(0.5) + a * F.log(x) + b * F.log(rest))
    # Each fraction converges fast on its side of the mean.
    near = rest < 1.5 / (a + 2.5)
    tail = F.when(near, 1 - front * _fraction(b, a, rest, steps) / b).otherwise(front * _fraction(a, b, x, steps) / a)
    return F.when(t == 0, 1.0).when(df > 0, tail)


def quantile(tail: float, df: Column) -> Column:
    """The t that |T| exceeds with probability ``tail``, by Newton's method.

    The tail is convex in t and the normal quantile lies below, so the steps rise to the solution.
    """
    peak = F.exp(log_gamma(df / 2 + 0.5) - log_gamma(df / 2)) / F.sqrt(math.pi * df)
    start = F.struct(F.lit(NormalDist().inv_cdf(1 - tail / 2)).alias("t"), peak.alias("peak"))

    def step(s: Column, _: Column) -> Column:
        t = s["t"]
        density = s["peak"] * F.exp(-(df + 1) / 2 * F.log1p(t * t / df))
        further = t + (two_sided_tail(t, df) - tail) / (2 * density)
        return F.struct(further.alias("t"), s["peak"].alias("peak"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(_NEWTON)), start, step, lambda s: s["t"])
    return F.when(df > 0, found)
