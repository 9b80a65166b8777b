"""Control conditions of vector fields, permuted sparse maps, and links widened by correlation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .profiles import exact_quantiles
from .resampling import permuted
from .spectral import WIDE, gram

#: Lengths up to this one count as none.
NOTHING = 1e-8


def length(v: str):
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def shuffled(x: DataFrame, seed: int) -> DataFrame:
    """(id, v) with ``other_v``, the vector of another row under one random permutation."""
    pm = permuted(x, "id", 1, seed).select("id", "other")
    return x.join(pm, "id").join(x.select(F.col("id").alias("other"), F.col("v").alias("other_v")), "other").drop("other")


def corrupted(x: DataFrame, share: float, seed: int) -> DataFrame:
    """(id, v): the mixture (1 - share) v + share v[permuted], scaled so that the median length of the rows that have one is
    that of ``x``; as it is where a side has none. A share outside 0 and 1 raises."""
    if not 0 <= share <= 1:
        raise ValueError("the share of a mixture lies between 0 and 1")
    mixed = shuffled(x, seed).select("id", "v", F.zip_with("v", "other_v", lambda a, b: (1 - share) * a + share * b).alias("m"))
    lengths = mixed.select(F.explode(F.array(F.struct(F.lit("v").alias("side"), length("v").alias("n")), F.struct(F.lit("m").alias("side"), length("m").alias("n")))).alias("s")).select("s.*")
    q = exact_quantiles(lengths.filter(F.col("n") > NOTHING), ["side"], "n", (0.5,))
    ratio = q.agg((F.max(F.when(F.col("side") == "v", F.col("quantile"))) / F.max(F.when(F.col("side") == "m", F.col("quantile")))).alias("ratio"))
    scale = F.coalesce("ratio", F.lit(1.0))
    return mixed.crossJoin(F.broadcast(ratio)).select("id", F.transform("m", lambda a: a * scale).alias("v"))  # ratio: one row


def permuted_axis(x: DataFrame, axis: str, seed: int) -> DataFrame:
    """The sparse (row, col, value) with the entries of each row (or column) that has any given to another such one."""
    pm = permuted(x.select(F.col(axis).alias("id")).distinct(), "id", 1, seed).select(F.col("id").alias("_to"), F.col("other").alias(axis))
    other = "col" if axis == "row" else "row"
    return x.join(pm, axis).select(F.col("_to").alias(axis), other, "value").select("row", "col", "value")


def correlated_columns(x: DataFrame, k: int) -> DataFrame:
    """(col, linked, weight): each column of the sparse (row, col, value) with itself and the ``k`` columns that are most
    correlated with it over all rows; weights are the correlations, 0 at least, over their sum; links of no weight are left out.

    Every task sums the products of its rows into one matrix, so no pairs are emitted; up to ``WIDE`` columns, more raise."""
    names = [r.col for r in x.select("col").distinct().orderBy("col").limit(WIDE + 1).collect()]
    if len(names) >= WIDE:
        raise ValueError(f"correlations are kept for fewer than {WIDE} columns")
    spark = x.sparkSession
    schema = f"col {x.schema['col'].dataType.simpleString()}, linked {x.schema['col'].dataType.simpleString()}, weight double"
    if not names:
        return spark.createDataFrame([], schema)
    places = F.broadcast(spark.createDataFrame(list(zip(names, range(len(names)), strict=True)), f"col {x.schema['col'].dataType.simpleString()}, at int"))  # fewer than WIDE rows
    cells = x.join(places, "col").groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("at", F.col("value").cast("double")))).alias("m"))
    dense = cells.select(F.transform(F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("v"))
    n, total, products = gram(dense, ["v"])
    cov = products / n - np.outer(total / n, total / n)
    spread = np.sqrt(np.maximum(np.diag(cov), 0.0))
    usable = spread > 1e-12
    out = []
    for i in np.flatnonzero(usable).tolist():
        corr = np.where(usable, cov[i] / (spread[i] * np.where(usable, spread, 1.0)), -np.inf)
        corr[i] = 1.0
        order = sorted(range(len(names)), key=lambda j: (j != i, -round(corr[j], 12), j))[: k + 1]
        weights = np.maximum(corr[order], 0.0)
        out += [(names[i], names[j], float(w / weights.sum())) for j, w in zip(order, weights, strict=True) if w > 0]
    return spark.createDataFrame(out, schema)
