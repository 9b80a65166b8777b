"""Numeric expressions of the kinetic models and schedules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def relaxation(source: Column, pool: Column, rate: Column, synthesis: Column, decay: Column) -> Column:
    """rate * (synthesis * source - decay * pool)."""
    return rate * (synthesis * source - decay * pool)


def splicing(unspliced: Column, spliced: Column, alpha: Column, beta: Column, gamma: Column) -> Column:
    """(alpha - beta u, beta u - gamma s)."""
    return F.struct((alpha - beta * unspliced).alias("du"), (beta * unspliced - gamma * spliced).alias("ds"))


def clipped_log1p(c: Column, scale: float = 1.0) -> Column:
    return F.log1p(F.greatest(c, F.lit(0.0)) * scale)


def clipped_exp(c: Column, low: float, high: float, rate: float = 1.0) -> Column:
    return rate * F.exp(F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def warm_cosine(step: Column, warm: int, total: int) -> Column:
    """Linear warm-up to 1, then half a cosine down to 0."""
    rest = (step - warm) / float(max(total - warm, 1))
    return F.when(step < warm, (step + 1) / float(max(warm, 1))).otherwise(0.5 * (1 + F.cos(F.lit(3.141592653589793) * F.least(rest, F.lit(1.0)))))


def ramp(step: Column, width: int) -> Column:
    return F.least(step / float(max(width, 1)), F.lit(1.0))


def interpolated(x: Column, knots: list[tuple[float, float]]) -> Column:
    """Piecewise linear through a short fixed list of points, constant beyond its ends."""
    ks = sorted(knots)
    out = F.lit(float(ks[-1][1]))
    for (x0, y0), (x1, y1) in reversed(list(zip(ks, ks[1:], strict=False))):
        out = F.when(x <= x1, F.lit(float(y0)) + (x - x0) * ((y1 - y0) / (x1 - x0))).otherwise(out)
    return F.when(x.isNotNull(), F.when(x <= ks[0][0], float(ks[0][1])).otherwise(out))
