"""Factorisations: principal axes, latent semantic indexing, ridge and a linear ODE. SQL has no eigenvectors; tests compare with NumPy.

Sparse matrix: row = order, column = part size, value = summed quantity. Dense rows: parts of the embeddings. Fitted on ids divisible by 3.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import matrix, spectral
from ..sources.tables import table
from .registry import query

#: Components, and penalties of the ridge regressions: 33 from 0.01 to a million, evenly spaced in logarithms.
COMPONENTS = 4
ALPHAS = [10.0 ** (-2 + i / 4) for i in range(33)]


def baskets(spark: SparkSession, d: str) -> DataFrame:
    li, p = table(spark, d, "lineitem"), table(spark, d, "part")
    x = li.join(p, li.l_partkey == p.p_partkey)
    return x.groupBy(F.col("l_orderkey").alias("row"), F.col("p_size").alias("col")).agg(F.sum("l_quantity").alias("value"))


def weighted(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """TF-IDF weights fitted on every third order, and these orders."""
    x = baskets(spark, d)
    fit = x.filter("row % 3 = 0").select("row").distinct()
    return matrix.tfidf(x, fit), fit


def dense(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def part(first: int, n: int) -> Column:
    return F.slice("embedding", first, n)


@query()
def fac_pca(spark: SparkSession, d: str) -> DataFrame:
    """Scores of all rows on the axes of the fitted ones."""
    x = dense(spark, d)
    mean, axes, _, _ = spectral.principal_axes(x, "embedding", F.col("id") % 3 == 0, COMPONENTS)
    return spectral.project(x, "embedding", mean, axes, "v").select("id", F.posexplode("v").alias("component", "score"))


@query()
def fac_pca_axes(spark: SparkSession, d: str) -> DataFrame:
    """Loadings, variance and share of the variance of each axis."""
    _, axes, var, share = spectral.principal_axes(dense(spark, d), "embedding", F.col("id") % 3 == 0, COMPONENTS)
    rows = [(k, i, float(axes[i, k]), float(var[k]), float(share[k])) for k in range(axes.shape[1]) for i in range(len(axes))]
    return spark.createDataFrame(rows, "component int, feature int, loading double, variance double, share double")


@query()
def fac_lsi(spark: SparkSession, d: str) -> DataFrame:
    """Latent semantic indexing: every order on components 2 to 4."""
    v, _ = spectral.lsi(*weighted(spark, d), COMPONENTS)
    return v.select("row", F.posexplode("v").alias("component", "score"))


@query()
def fac_low_rank(spark: SparkSession, d: str) -> DataFrame:
    """Centred TF-IDF weights rebuilt from four components, in all cells."""
    return spectral.low_rank(*weighted(spark, d), COMPONENTS)


@query()
def fac_ridge(spark: SparkSession, d: str) -> DataFrame:
    """Four entries of each embedding predicted from 32 others."""
    x = dense(spark, d).select("id", part(1, 32).alias("x"), part(33, 4).alias("y"))
    got, _ = spectral.ridge(x, "x", "y", F.col("id") % 3 == 0, ALPHAS, "predicted")
    return got.select("id", F.posexplode("predicted").alias("target", "predicted"))


@query()
def fac_ridge_alphas(spark: SparkSession, d: str) -> DataFrame:
    """Leave-one-out error of every penalty."""
    x = dense(spark, d).select("id", part(1, 32).alias("x"), part(33, 4).alias("y"))
    _, errors = spectral.ridge(x, "x", "y", F.col("id") % 3 == 0, ALPHAS, "predicted")
    best = min(e for _, e in errors)
    return spark.createDataFrame([(a, e, e == best) for a, e in errors], "alpha double, loo_error double, chosen boolean")


@query()
def fac_linear_ode(spark: SparkSession, d: str) -> DataFrame:
    """W, A and the costs of 50 rounds of alternating least squares, in one table of cells."""
    x = dense(spark, d).select(part(1, 8).alias("r"), part(9, 8).alias("v"), part(17, 4).alias("p"))
    w, a, costs = spectral.linear_ode(x, "r", "v", "p", [0.4, 0.6, 0.8, 1.0])
    cells = [(n, i, j, float(m[i, j])) for n, m in (("W", w), ("A", a)) for i in range(m.shape[0]) for j in range(m.shape[1])]
    return spark.createDataFrame([*cells, *(("cost", 0, k, c) for k, c in enumerate(costs))], "matrix string, i int, j int, value double")
