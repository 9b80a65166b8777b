"""Long-form sparse matrices (row, col, value): normalisation, filters, alignment, calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import ratio
from .profiles import exact_quantiles


def frequent_columns(x: DataFrame, least: int) -> DataFrame:
    """Keep columns that are positive in at least ``least`` rows."""
    keep = x.groupBy("col").agg(F.count_if(F.col("value") > 0).alias("n")).filter(F.col("n") >= least)
    return x.join(keep.select("col"), "col", "left_semi")


def size_normalised(x: DataFrame, target: float = 1e4) -> DataFrame:
    """log1p of values scaled to ``target`` per row."""
    total = x.groupBy("row").agg(F.sum("value").alias("total"))
    return x.join(total, "row").select("row", "col", F.log1p(F.coalesce(ratio(F.col("value"), F.col("total")), F.lit(0.0)) * target).alias("value"))


def centred_log_ratio(x: DataFrame, n_columns: int) -> DataFrame:
    """log1p less the row's mean log1p over all ``n_columns``; zeros that the sparse form leaves out count in the mean."""
    mean = x.groupBy("row").agg((F.sum(F.log1p("value")) / n_columns).alias("mean"))
    return x.join(mean, "row").select("row", "col", (F.log1p("value") - F.col("mean")).alias("value"))


def size_factor(x: DataFrame, totals: DataFrame) -> DataFrame:
    """log1p(value / max(total, 1) * median total); ``totals`` has (row, total)."""
    median = exact_quantiles(totals.select(F.greatest("total", F.lit(1.0)).alias("total")), [], "total", (0.5,)).select(F.col("quantile").alias("median"))
    return x.join(totals, "row").crossJoin(F.broadcast(median)).select("row", "col", F.log1p(F.col("value") / F.greatest("total", F.lit(1.0)) * F.col("median")).alias("value"))


def tfidf(x: DataFrame, fit: DataFrame) -> DataFrame:
    """Binarised term frequency times log(1 + N / df) with df from the rows in ``fit`` (row), times 1e4, log1p."""
    ones = x.filter("value > 0").select("row", "col")
    n = ones.groupBy("row").agg(F.count("*").alias("n"))
    of_fit = ones.join(fit.select("row"), "row", "left_semi")
    size = fit.agg(F.count("*").alias("size"))
    df = of_fit.groupBy("col").agg(F.count("*").alias("df")).crossJoin(F.broadcast(size))
    idf = df.select("col", F.log1p(F.col("size") / F.col("df")).alias("idf"))
    return ones.join(n, "row").join(idf, "col").select("row", "col", F.log1p(F.col("idf") / F.col("n") * 1e4).alias("value"))


def standardise(x: DataFrame, fit: DataFrame) -> DataFrame:
    """z-scores per column with mean and population deviation of the rows in ``fit``; deviation 0 divides by 1."""
    s = x.join(fit.select("row"), "row", "left_semi").groupBy("col").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    return x.join(s, "col").select("row", "col", ((F.col("value") - F.col("m")) / F.when(F.col("s") > 1e-12, F.col("s")).otherwise(1.0)).alias("value"))


def minmax(x: DataFrame) -> DataFrame:
    """Per column to [0, 1]; constant columns give 0."""
    s = x.groupBy("col").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return x.join(s, "col").select("row", "col", F.coalesce(ratio(F.col("value") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0)).alias("value"))


def reindex(x: DataFrame, rows: DataFrame, target: DataFrame) -> DataFrame:
    """Every (row, target column) cell, zero where ``x`` has none. ``target`` (col) is the wanted list of columns."""
    grid = rows.select("row").crossJoin(F.broadcast(target.select("col")))  # the result's own size
    return grid.join(x, ["row", "col"], "left").select("row", "col", F.coalesce("value", F.lit(0.0)).alias("value"))


def calibration(df: DataFrame, least_ratio: float = 0.0) -> DataFrame:
    """Per column of (col, predicted, observed, is_control): least squares slope and intercept, and the positive
    scale sd(observed) / sd(predicted), all from control rows. Constant predictions give slope 1 and scale 1;
    predictions whose deviation is at most ``least_ratio`` times the observed one give scale null."""
    c = df.filter("is_control")
    sp, so = F.stddev_pop("predicted"), F.stddev_pop("observed")
    constant = sp <= 1e-12
    slope = F.when(constant, 1.0).otherwise(F.covar_pop("predicted", "observed") / F.when(~constant, sp * sp))
    s = c.groupBy("col").agg(F.count("*").alias("n"), slope.alias("slope"), F.avg("predicted").alias("mp"), F.avg("observed").alias("mo"), F.when(constant, 1.0).when(sp > least_ratio * so, so / F.when(~constant, sp)).alias("scale"))
    return s.select("col", "n", "slope", (F.col("mo") - F.col("slope") * F.col("mp")).alias("intercept"), "scale")


def log_velocity(x: DataFrame, target: float = 1e4) -> DataFrame:
    """Derivative of the size-normalised log value, by the quotient rule, of (row, col, value, velocity)."""
    s = x.groupBy("row").agg(F.sum("value").alias("t"), F.sum("velocity").alias("dt"))
    inner = (F.col("velocity") * F.col("t") - F.col("value") * F.col("dt")) / F.when(F.col("t") > 0, F.col("t") * F.col("t"))
    return x.join(s, "row").select("row", "col", F.coalesce(target * inner / (1 + target * F.col("value") / F.when(F.col("t") > 0, F.col("t"))), F.lit(0.0)).alias("value"))


def weighted_mean(weights: DataFrame, x: DataFrame) -> DataFrame:
    """Barycentric average: (target, row, weight) with (row, col, value); weights are normalised per target."""
    total = weights.groupBy("target").agg(F.sum("weight").alias("total"))
    s = weights.join(x, "row").groupBy("target", "col").agg(F.sum(F.col("weight") * F.col("value")).alias("s"))
    return s.join(total, "target").select("target", "col", ratio(F.col("s"), F.col("total")).alias("value"))


def onehot_ridge(df: DataFrame, held_out: str, least: int, alpha: float, control: str) -> DataFrame:
    """Ridge on one-hot groups in closed form: sum(x - control mean) / (n + alpha), without the held-out replicate."""
    fit = df.filter(F.col("replicate") != held_out)
    base = fit.filter(F.col("grp") == control).groupBy("measure").agg(F.avg("value").alias("base"))
    out = fit.filter(F.col("grp") != control).join(base, "measure").groupBy("grp", "measure").agg(F.count("*").alias("n"), F.sum(F.col("value") - F.col("base")).alias("s"))
    return out.filter(F.col("n") >= least).select("grp", "measure", "n", (F.col("s") / (F.col("n") + alpha)).alias("effect"))
