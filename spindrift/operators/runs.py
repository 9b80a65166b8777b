"""Tables of experiment runs: aggregates, paired deltas against a baseline, winners, grids, flags."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranks import numbered


def aggregate(runs: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """Per configuration: rows, distinct seeds, missing values, mean and sample deviation of the metric."""
    return runs.groupBy(*keys).agg(F.count("*").alias("n"), F.countDistinct("seed").alias("n_seeds"), F.count_if(F.col(metric).isNull()).alias("bad"), F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("sd"))


def paired_deltas(runs: DataFrame, key: str, pair: list[str], metric: str, baseline: str) -> DataFrame:
    """Per key value: deltas to the baseline's run of the same pair columns; mean, deviation, count and wins (delta < 0).

    ``runs`` must have one row per key and pair; a missing partner leaves the pair out."""
    base = runs.filter(F.col(key) == baseline).select(*pair, F.col(metric).alias("_b"))
    d = runs.filter(F.col(key) != baseline).join(base, pair).withColumn("_d", F.col(metric) - F.col("_b"))
    return d.groupBy(key).agg(F.count("_d").alias("n"), F.avg("_d").alias("mean_delta"), F.stddev_samp("_d").alias("sd_delta"), F.count_if(F.col("_d") < 0).alias("wins"))


def summary(df: DataFrame, key: str, metric: Column) -> DataFrame:
    """Mean, deviation, extremes and count of a metric coerced to a number; what is no number is left out."""
    x = df.select(F.col(key), metric.alias("_m"))
    return x.groupBy(key).agg(F.avg("_m").alias("mean"), F.stddev_samp("_m").alias("std"), F.min("_m").alias("min"), F.max("_m").alias("max"), F.count("_m").alias("count"))


def winner(deltas: DataFrame, key: str) -> DataFrame:
    """The key with the smallest mean delta; ties: more wins, then the first name."""
    return deltas.orderBy(F.col("mean_delta").asc_nulls_last(), F.desc("wins"), key).limit(1)


def flags(tests: list[tuple[str, Column]]) -> Column:
    """Names of the conditions that hold, comma-joined in order."""
    return F.concat_ws(",", *(F.when(test, name) for name, test in tests))


def densify(df: DataFrame, axes: dict[str, list], value: str) -> DataFrame:
    """One row per combination of the axes' values (fixed short lists), null where ``df`` has none."""
    names = list(axes)
    grid = df.sparkSession.createDataFrame([*product(*axes.values())], df.select(*names).schema)
    return grid.join(df.select(*names, value), names, "left")


def duplicate_arms(runs: DataFrame, arm: str, pair: list[str], metric: str, tolerance: float, least: int) -> DataFrame:
    """Pairs of arms whose metrics agree within ``tolerance`` on all of at least ``least`` common pair columns."""
    a = runs.select(*pair, F.col(arm).alias("arm_a"), F.col(metric).alias("_a"))
    b = runs.select(*pair, F.col(arm).alias("arm_b"), F.col(metric).alias("_b"))
    both = a.join(b, pair).filter("arm_a < arm_b").groupBy("arm_a", "arm_b").agg(F.count("*").alias("n"), F.max(F.abs(F.col("_a") - F.col("_b"))).alias("gap"))
    return both.filter((F.col("n") >= least) & (F.col("gap") < tolerance))


def settling_point(df: DataFrame, key: str, step: str, value: str, tolerance: float = 0.5) -> DataFrame:
    """First step after which a series stays within ``tolerance`` of its last value, relative to that. Null for fewer
    than three points and for a last value that is not a positive, finite number."""
    last = df.groupBy(key).agg(F.max_by(value, step).alias("_end"), F.count("*").alias("_n"))
    x = df.join(last, key).withColumn("_out", ~(F.abs(F.col(value) - F.col("_end")) <= tolerance * F.col("_end")))
    bad = x.groupBy(key).agg(F.max(F.when(F.coalesce("_out", F.lit(True)), F.col(step))).alias("_bad"))
    sound = (F.col("_n") >= 3) & (F.col("_end") > 0) & (F.col("_end") < float("inf"))
    after = sound & (F.col("_bad").isNull() | (F.col(step) > F.col("_bad")))
    return x.join(bad, key).groupBy(key).agg(F.min(F.when(after, F.col(step))).alias("settled"))


def ecdf(df: DataFrame, key: str, value: str) -> DataFrame:
    """Distinct values with the share of rows at or below them."""
    n = df.groupBy(key, value).agg(F.count("*").alias("_n"))
    upto = W.partitionBy(key).orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    return n.withColumn("share", F.sum("_n").over(upto) / F.sum("_n").over(W.partitionBy(key))).drop("_n")


def best_so_far(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Running minimum of a history."""
    return df.withColumn("best", F.min(value).over(W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)))


def bootstrap_mean(units: DataFrame, unit: str, value: str, draws: int, seed: int) -> DataFrame:
    """Percentile interval of the mean under resampling of whole units with replacement.

    Draw b, slot s takes the unit whose rank is floor(hash("seed:b:s") * n); only sums per unit are resampled."""
    per = units.groupBy(unit).agg(F.sum(value).alias("s"), F.count(value).alias("c"))
    ranked = numbered(per, F.col(unit)).withColumn("r", F.col("_r") - 1)
    n = ranked.count()
    # a row per draw and slot, made where it is used
    slots = units.sparkSession.range(draws * n).select(F.expr(f"id DIV {max(n, 1)}").alias("b"), (F.col("id") % max(n, 1)).alias("slot"))
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "b", "slot")), 1, 13), 16, 10).cast("long") / F.lit(2.0**52)
    picked = slots.withColumn("r", F.floor(u * n))
    means = picked.join(ranked, "r").groupBy("b").agg((F.sum("s") / F.sum("c")).alias("m"))
    return means.agg(F.count("*").alias("draws"), F.percentile("m", 0.025).alias("lower"), F.percentile("m", 0.975).alias("upper"), F.avg("m").alias("mean"))
