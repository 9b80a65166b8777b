"""Statistical column expressions: guarded correlation sums, tie-averaged ranks, normal tail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.when(b != 0, a / b)


def pearson(x: str, y: str) -> Column:
    """Pearson correlation of a group; null for a constant side or fewer than two rows."""
    a, b = F.col(x), F.col(y)
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when((F.count(a) >= 2) & (spread > 1e-12), F.covar_pop(a, b) / F.when(spread > 1e-12, spread))


def average_rank(value: str, *keys: str) -> Column:
    """Ranks within ``keys``, ties sharing their mean rank."""
    order = W.partitionBy(*keys).orderBy(F.col(value).asc_nulls_last())
    ties = W.partitionBy(*keys, value)
    return F.rank().over(order) + (F.count(F.lit(1)).over(ties) - 1) / 2.0


#: Coefficients of the Chebyshev fit of the complementary error function whose relative error is below 1.2e-7 everywhere.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def normal_two_sided_log(z: str | Column) -> Column:
    """Natural logarithm of the two-sided tail of the standard normal distribution at |z|; far tails don't vanish."""
    x = F.abs(col(z)) / F.sqrt(F.lit(2.0))
    t = 1.0 / (1.0 + 0.5 * x)
    poly = F.lit(0.0)
    for c in reversed(ERFC):
        poly = poly * t + c
    return F.log(t) - x * x + poly


def normal_two_sided(z: str | Column) -> Column:
    """Two-sided tail of the standard normal distribution at |z|."""
    return F.least(F.lit(1.0), F.exp(normal_two_sided_log(z)))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, minus zero made zero: what the registered queries return."""
    return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))
