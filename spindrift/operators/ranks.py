"""Positions in a global order without gathering the rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import write_table


def numbered(df: DataFrame, *order: Column, out: str = "_r") -> DataFrame:
    """Add ``out``, the position (from 1) in the order, and ``_part``, the range it lies in.

    Rows are dealt by ranges of the order and written; counts per range, a row each, give the offsets.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = write_table(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "numbered")
    n = x.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))  # one row per range
    offsets = n.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return x.join(F.broadcast(offsets), "_part").withColumn(out, own + F.col("_before")).drop("_before")


def least_from_here_on(df: DataFrame, value: str, out: str) -> DataFrame:
    """Add ``out``: the least ``value`` among a row of ``numbered`` and all after it."""
    per = df.groupBy("_part").agg(F.min(value).alias("_m"))
    later = F.min("_m").over(W.orderBy("_part").rowsBetween(1, W.unboundedFollowing))  # one row per range
    after = per.select("_part", later.alias("_later"))
    own = F.min(value).over(W.partitionBy("_part").orderBy("_r").rowsBetween(0, W.unboundedFollowing))
    return df.join(F.broadcast(after), "_part").withColumn(out, F.least(own, F.col("_later"))).drop("_later")
