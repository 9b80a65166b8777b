"""Resampling of whole units by hashes: the same draws on any cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import numbered


def drawn(df: DataFrame, unit: str, draws: int, seed: int) -> DataFrame:
    """Rows of ``df`` once for each time their unit is drawn, with the draw ``b``.

    Draw b, slot s takes the unit at place floor(hash("seed:b:s") * n). Units times draws are built: for tables of
    effects or of sums per unit."""
    units = numbered(df.select(unit).distinct(), F.col(unit)).select(unit, (F.col("_r") - 1).cast("long").alias("_k"))
    n = units.count()
    # a row per draw and slot, made where it is used
    slots = df.sparkSession.range(draws * n).select(F.expr(f"id DIV {max(n, 1)}").alias("b"), (F.col("id") % max(n, 1)).alias("_s"))
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "b", "_s")), 1, 13), 16, 10).cast("long") / F.lit(2.0**52)
    taken = slots.select("b", F.floor(h * n).alias("_k")).groupBy("b", "_k").agg(F.count("*").cast("int").alias("_times"))
    times = taken.join(units, "_k").select("b", unit, "_times")
    return df.join(times, unit).withColumn("_times", F.explode(F.array_repeat(F.lit(1), F.col("_times")))).drop("_times")


def interval(df: DataFrame, value: str) -> DataFrame:
    """Count, mean and 2.5 and 97.5 percentiles of one value per draw; null draws don't count."""
    x = df.filter(F.col(value).isNotNull())
    return x.agg(F.count(value).alias("draws"), F.avg(value).alias("mean"), F.percentile(value, 0.025).alias("lower"), F.percentile(value, 0.975).alias("upper"))


def permuted(df: DataFrame, key: str, draws: int, seed: int) -> DataFrame:
    """(b, key, other): in draws b = 1.. a random permutation of the rows of ``df``, one row each per key.

    Draw b sets the rows in order of key beside the rows in order of md5("seed:b:key"). Rows times draws are numbered by ranges."""
    ids = df.select(key)
    base = numbered(ids, F.col(key)).select(F.col("_r").alias("_at"), key)
    n = ids.agg(F.count("*").alias("_n"))
    all_ = ids.crossJoin(df.sparkSession.range(1, draws + 1).withColumnRenamed("id", "b")).withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), "b", key)))
    mixed = numbered(all_, F.col("b"), F.col("_h"), F.col(key)).crossJoin(F.broadcast(n))  # one row
    return mixed.select("b", F.col(key).alias("other"), (F.col("_r") - (F.col("b") - 1) * F.col("_n")).alias("_at")).join(base, "_at").select("b", key, "other")
