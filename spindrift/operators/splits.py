"""Seeded splits by hashes of identifiers: the same rows on any partitioning, any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def hash_fraction(identifier: str, seed: int) -> Column:
    """A number in [0, 1) from the first 52 bits of md5("seed:id")."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(identifier).cast("string"))), 1, 13), 16, 10).cast("long") / F.lit(2.0**52)


def hash_split(df: DataFrame, identifier: str, fraction: float, seed: int) -> DataFrame:
    """Add ``selected``: whether the identifier's hash lies below ``fraction``; independent of all other rows."""
    return df.withColumn("selected", hash_fraction(identifier, seed) < fraction)


def stratified_split(df: DataFrame, identifier: str, stratum: str, fraction: float, seed: int) -> DataFrame:
    """Add ``selected``: the floor(fraction * n + 0.5) rows of lowest hash in each stratum."""
    order = W.partitionBy(stratum).orderBy("_h", identifier)
    whole = W.partitionBy(stratum)
    x = df.withColumn("_h", hash_fraction(identifier, seed))
    return x.withColumn("selected", F.row_number().over(order) <= F.floor(fraction * F.count("*").over(whole) + 0.5)).drop("_h")


def three_way_split(df: DataFrame, identifier: str, stratum: str, validation: float, test: float, seed: int) -> DataFrame:
    """Add ``part``: test, validation, or one of two halves of the rest, per stratum in order of hash; shares are
    rounded half to even."""
    order, whole = W.partitionBy(stratum).orderBy("_h", identifier), W.partitionBy(stratum)
    x = df.withColumn("_h", hash_fraction(identifier, seed)).withColumn("_r", F.row_number().over(order)).withColumn("_n", F.count("*").over(whole))
    n_test, n_val = F.bround(F.col("_n") * test), F.bround(F.col("_n") * validation)
    part = F.when(F.col("_r") <= n_test, "test").when(F.col("_r") <= n_test + n_val, "validation").when((F.col("_r") - n_test - n_val) % 2 == 1, "train_a").otherwise("train_b")
    return x.withColumn("part", part).drop("_h", "_r", "_n")


def split_digest(df: DataFrame, identifier: str, *by: str) -> DataFrame:
    """Order-independent digest of a set of identifiers: count, and the sum of their 52-bit md5 prefixes.
    A sum keeps the digest a partial aggregation, where a sorted list would gather all ids in one task."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.conv(F.substring(F.md5(F.col(identifier).cast("string")), 1, 13), 16, 10).cast("decimal(38,0)")).cast("string").alias("digest"))
