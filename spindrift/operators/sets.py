"""Set operations on keyed tables, and filters that decide over whole columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def per_subset(df: DataFrame, subsets: dict[str, Column], out: str = "subset") -> DataFrame:
    """One copy of a row for every subset it belongs to."""
    names = F.array_compact(F.array(*(F.when(test, name) for name, test in subsets.items())))
    return df.withColumn(out, F.explode(names))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``old`` whose key is not in ``new``, and all of ``new``; missing columns become null."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def key_differences(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one side has, with the side; empty if the key sets are equal."""
    x, y = a.select(*keys).distinct(), b.select(*keys).distinct()
    return x.join(y, keys, "left_anti").withColumn("side", F.lit("left")).union(y.join(x, keys, "left_anti").withColumn("side", F.lit("right")))


def require_disjoint(a: DataFrame, b: DataFrame, keys: list[str]) -> None:
    """Raise if the sides share a key (an action)."""
    shared = a.select(*keys).join(b.select(*keys), keys, "left_semi").limit(3).collect()
    if shared:
        raise ValueError(f"shared keys: {shared}")


def first_occurrences(df: DataFrame, key: str, order: str) -> DataFrame:
    """Add ``is_first``: whether the row is the first of its key; the others are the dropped ones."""
    return df.withColumn("is_first", F.row_number().over(W.partitionBy(key).orderBy(order)) == 1)


def variable_columns(x: DataFrame, fit: DataFrame, n: int, retain: DataFrame) -> DataFrame:
    """The ``n`` columns of largest dispersion (variance over mean of the rows in ``fit``), and those in ``retain``."""
    s = x.join(fit.select("row"), "row", "left_semi").groupBy("col").agg((F.var_pop("value") / F.when(F.avg("value") > 0, F.avg("value"))).alias("dispersion"))
    top = s.orderBy(F.col("dispersion").desc_nulls_last(), "col").limit(n).select("col")
    return top.union(retain.select("col")).distinct()


def finite_rows(df: DataFrame, *columns: str) -> DataFrame:
    """Rows that are finite in every named column."""
    out = df
    for c in columns:
        out = out.filter(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return out


def has_fractions(df: DataFrame, value: str, tolerance: float = 1e-6) -> DataFrame:
    """Whether any value is no integer: tells normalised from raw counts."""
    return df.agg(F.coalesce(F.bool_or(F.abs(F.col(value) - F.rint(value)) > tolerance), F.lit(False)).alias("has_fractions"))


def nested_subset(df: DataFrame, identifier: str, n: int, seed: int) -> DataFrame:
    """The first ``n`` rows of one seeded permutation, so that smaller subsets lie inside larger ones."""
    return df.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(identifier).cast("string")))).orderBy("_h", identifier).limit(n).drop("_h")
