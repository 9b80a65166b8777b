"""Resolution of names: aliases, best of several formats, prioritised reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def normalised(name: Column) -> Column:
    """Upper case without anything but letters and digits; null for empty and 'nan'."""
    x = F.upper(F.regexp_replace(name, "[^A-Za-z0-9]", ""))
    return F.when(~x.isin("", "NAN"), x)


def alias_lookup(names: DataFrame) -> DataFrame:
    """(alias, pos): the first position of each normalised alias of (pos, name, priority)."""
    x = names.withColumn("alias", normalised(F.col("name"))).filter("alias is not null")
    return x.groupBy("alias").agg(F.min(F.struct("priority", "pos")).alias("m")).select("alias", F.col("m.pos").alias("pos"))


def best_format(ids: DataFrame, known: DataFrame, formats: list[Column]) -> DataFrame:
    """The format (an expression over ``id``) under which most ids are found in ``known`` (id); ties: the earliest."""
    spelt = ids.select("id", F.posexplode(F.array(*formats)).alias("format", "name"))
    hits = spelt.join(known.select(F.col("id").alias("name")).distinct(), "name", "left_semi").groupBy("format").agg(F.count("*").alias("n"))
    return hits.orderBy(F.desc("n"), "format").limit(1)


def first_reason(conditions: list[tuple[str, Column]], otherwise: str) -> Column:
    """The name of the first condition that holds."""
    out = F.when(F.lit(False), "")
    for name, test in conditions:
        out = out.when(test, name)
    return out.otherwise(otherwise)


def newest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the last in ``order``; null keys form a group."""
    w = W.partitionBy(*keys).orderBy(*(F.col(c).desc_nulls_last() for c in order))
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
