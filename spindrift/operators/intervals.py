"""Intervals (chrom, start, end): union, overlap and band joins by bins, so that no join compares all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def merge_union(iv: DataFrame) -> DataFrame:
    """Union of intervals per chromosome; touching intervals merge. A running maximum over the sorted starts."""
    order = W.partitionBy("chrom").orderBy("start", "end")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    marked = iv.withColumn("_new", (F.col("start") > F.coalesce(F.max("end").over(before), F.col("start") - 1)).cast("int"))
    numbered = marked.withColumn("block", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy("chrom", "block").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n")).drop("block")


def overlap_pairs(iv: DataFrame, width: int, decay: float) -> DataFrame:
    """Pairs a < b of overlapping intervals of one chromosome with weight exp(-midpoint distance / decay).

    Intervals are filed under every bin of ``width`` that they touch; a pair is kept only in the bin where
    the later of both starts lies, so it is found once."""
    last = F.greatest(F.col("end") - 1, F.col("start"))
    binned = iv.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(last / width))))
    a, b = (binned.select(F.col("chrom"), F.col("bin"), F.col("id").alias(f"id_{s}"), F.col("start").alias(f"s_{s}"), F.col("end").alias(f"e_{s}")) for s in "ab")
    both = a.join(b, ["chrom", "bin"]).filter("id_a < id_b and s_a < e_b and s_b < e_a").filter(F.floor(F.greatest("s_a", "s_b") / width) == F.col("bin"))
    gap = F.abs((F.col("s_a") + F.col("e_a")) / 2 - (F.col("s_b") + F.col("e_b")) / 2)
    return both.select("chrom", "id_a", "id_b", F.exp(-gap / decay).alias("weight"))


def band_pairs(iv: DataFrame, reach: int, decay: float) -> DataFrame:
    """Ordered pairs of one chromosome with midpoints at most ``reach`` apart, weights exp(-d / decay) normalised
    per first interval. Each interval meets its own bin of width ``reach`` and both neighbours."""
    mid = iv.select("chrom", "id", ((F.col("start") + F.col("end")) / 2).alias("mid"))
    home = mid.select("chrom", F.floor(F.col("mid") / reach).alias("bin"), F.col("id").alias("id_a"), F.col("mid").alias("m_a"))
    near = mid.select("chrom", F.explode(F.array(*(F.floor(F.col("mid") / reach) + k for k in (-1, 0, 1)))).alias("bin"), F.col("id").alias("id_b"), F.col("mid").alias("m_b"))
    gap = F.abs(F.col("m_a") - F.col("m_b"))
    pairs = home.join(near, ["chrom", "bin"]).filter(F.col("id_a") != F.col("id_b")).filter(gap <= reach).select("chrom", "id_a", "id_b", F.exp(-gap / decay).alias("w"))
    total = pairs.groupBy("id_a").agg(F.sum("w").alias("t"))
    return pairs.join(total, "id_a").select("chrom", "id_a", "id_b", (F.col("w") / F.col("t")).alias("weight"))
