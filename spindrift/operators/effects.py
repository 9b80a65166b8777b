"""Contrasts of groups against a control within replicates, and what follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import normal_two_sided, ratio
from .ranks import least_from_here_on, numbered


def group_contrast(cells: DataFrame, control: str, grp: str = "grp", replicate: str = "replicate", measure: str = "measure", value: str = "value", cognate: str = "cognate") -> DataFrame:
    """Per group, replicate and measure: mean difference to the control of the same replicate, and its Welch
    standard error. Both sides need two rows; the control itself is not returned. One shuffle of partial sums:
    the control's rows are few (replicates times measures) and joined by key."""
    stats = cells.groupBy(F.col(grp).alias("grp"), F.col(replicate).alias("replicate"), F.col(measure).alias("measure")).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var"), F.avg(cognate).alias("cog")
    )
    base = stats.filter(F.col("grp") == control).select("replicate", "measure", F.col("n").alias("n0"), F.col("mean").alias("mean0"), F.col("var").alias("var0"), F.col("cog").alias("cog0"))
    both = stats.filter(F.col("grp") != control).join(base, ["replicate", "measure"]).filter("n >= 2 and n0 >= 2")
    return both.select(
        "grp", "replicate", "measure", F.col("n").alias("n_group"), F.col("n0").alias("n_control"), (F.col("mean") - F.col("mean0")).alias("delta"),
        (F.col("cog") - F.col("cog0")).alias("delta_cognate"), F.sqrt(F.col("var") / F.col("n") + F.col("var0") / F.col("n0")).alias("se"),
    )


def sufficient_groups(cells: DataFrame, control: str, least: int, replicates: int, grp: str = "grp", replicate: str = "replicate") -> DataFrame:
    """Groups with at least ``least`` rows in each of at least ``replicates`` replicates."""
    per = cells.filter(F.col(grp) != control).groupBy(F.col(grp).alias("grp"), replicate).count().filter(F.col("count") >= least)
    return per.groupBy("grp").agg(F.count("*").alias("n_replicates")).filter(F.col("n_replicates") >= replicates)


def pooled_pairs(effects: DataFrame) -> DataFrame:
    """Per group and measure: mean effects over replicates, errors combined in quadrature, z and two-sided p."""
    out = effects.groupBy("grp", "measure").agg(
        F.avg("delta").alias("delta"), F.avg("delta_cognate").alias("delta_cognate"), F.countDistinct("replicate").alias("n_replicates"),
        (F.sqrt(F.sum(F.col("se") * F.col("se"))) / F.count("se")).alias("se"),
    )
    out = out.withColumn("z", ratio(F.col("delta"), F.col("se")))
    return out.withColumn("p", normal_two_sided("z"))


def bh_qvalues(df: DataFrame, p: str = "p", out: str = "q", *by: str) -> DataFrame:
    """Benjamini-Hochberg step-up: p * n / rank, running minimum from the largest p down, at most 1.

    Runs over an effect table (one row per pair), inside ``by`` if given. Null p stay null and don't count.
    """
    if by:
        n = F.count(p).over(W.partitionBy(*by))
        rank = F.row_number().over(W.partitionBy(*by).orderBy(F.col(p).asc_nulls_last()))
        down = W.partitionBy(*by).orderBy(F.col(p).desc_nulls_last(), F.col("_r").desc()).rowsBetween(W.unboundedPreceding, 0)
        ranked = df.withColumn("_n", n).withColumn("_r", rank).withColumn("_raw", F.when(F.col(p).isNotNull(), F.col(p) * F.col("_n") / F.col("_r")))
        return ranked.withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.min("_raw").over(down), F.lit(1.0)))).drop("_n", "_r", "_raw")
    ranked = numbered(df, F.col(p).asc_nulls_last())
    n = ranked.agg(F.count(p).alias("_n"))  # one row
    raw = ranked.crossJoin(F.broadcast(n)).withColumn("_raw", F.when(F.col(p).isNotNull(), F.col(p) * F.col("_n") / F.col("_r")))
    least = least_from_here_on(raw, "_raw", "_least")
    return least.withColumn(out, F.when(F.col(p).isNotNull(), F.least("_least", F.lit(1.0)))).drop("_n", "_r", "_raw", "_least", "_part")


def subset_flags(effects: DataFrame, pooled: DataFrame, alpha: float = 0.05, top: float = 0.75, bottom: float = 0.5) -> DataFrame:
    """Pair-level flags on replicate rows: significant pairs, and pairs with a large effect but a small cognate effect."""
    q = bh_qvalues(pooled)
    cuts = q.agg(F.percentile(F.abs("delta"), top).alias("hi"), F.percentile(F.abs("delta_cognate"), bottom).alias("lo"))
    flags = q.crossJoin(F.broadcast(cuts)).select("grp", "measure", (F.col("q") < alpha).alias("s"), ((F.abs("delta") >= F.col("hi")) & (F.abs("delta_cognate") <= F.col("lo"))).alias("t"))
    none = F.lit(False)
    return effects.join(flags, ["grp", "measure"], "left").withColumns({"in_significant": F.coalesce("s", none), "in_decoupled": F.coalesce("t", none)}).drop("s", "t")


def cohens_d(cells: DataFrame, control: str) -> DataFrame:
    """Per group and measure over all replicates: difference and Cohen's d with the pooled deviation sqrt((v1+v2)/2)."""
    s = cells.groupBy("grp", "measure").agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.var_samp("value").alias("v"))
    c = s.filter(F.col("grp") == control).select("measure", F.col("m").alias("m0"), F.col("v").alias("v0"))
    both = s.filter(F.col("grp") != control).join(c, "measure")
    delta = F.col("m") - F.col("m0")
    return both.select("grp", "measure", "n", delta.alias("delta"), ratio(delta, F.sqrt((F.col("v") + F.col("v0")) / 2)).alias("cohens_d"))
