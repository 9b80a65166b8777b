"""Summaries of distributions, couplings and confusions; rank tests and permutation nulls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import average_rank, normal_two_sided, pearson, ratio
from ..sources.shared import write_table


def exact_quantiles(df: DataFrame, by: list[str], value: str, shares: tuple[float, ...], buckets: int = 200) -> DataFrame:
    """(by..., n, share, quantile): exact quantiles, linear between ranks, of values that aren't null.

    Equal values are counted first; approximate quantiles cut each group's distinct values into buckets, whose
    counts tell in which bucket a rank lies; only the values of those buckets are put in order. So neither an
    aggregation buffer nor a sort ever holds all values of a group. Counts and cuts, which are read several times, are written.
    """
    g = [*by, "_one"]
    n = df.filter(F.col(value).isNotNull()).withColumn("_one", F.lit(0)).groupBy(*g, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    n = write_table(n, "quantiles")
    cuts = n.groupBy(*g).agg(F.percentile_approx("_v", F.array(*(F.lit(i / buckets) for i in range(1, buckets))), 20 * buckets).alias("_cuts"), F.sum("_c").alias("n"))
    cuts = write_table(cuts, "quantiles")  # sketches merged in another order are others: all readers must see the same
    filed = n.join(F.broadcast(cuts.select(*g, "_cuts")) if not by else cuts.select(*g, "_cuts"), g)
    filed = filed.withColumn("_b", F.size(F.filter("_cuts", lambda c: c < F.col("_v")))).drop("_cuts")
    held = filed.groupBy(*g, "_b").agg(F.sum("_c").alias("_c"))
    below = held.withColumn("_below", F.sum("_c").over(W.partitionBy(*g).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)))
    below = below.select(*g, "_b", F.coalesce("_below", F.lit(0)).alias("_below"), F.col("_c").alias("_in"))
    # the two ranks (from 0) that each share lies between
    asked = cuts.select(*g, "n", F.explode(F.array(*(F.lit(float(s)) for s in shares))).alias("share")).withColumn("_at", F.col("share") * (F.col("n") - 1))
    asked = asked.withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor("_at"), F.ceil("_at")))))
    place = asked.join(below, g).filter((F.col("_rank") >= F.col("_below")) & (F.col("_rank") < F.col("_below") + F.col("_in")))
    need = place.select(*g, "_b", "_below").distinct()
    order = W.partitionBy(*g, "_b").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    values = filed.join(need, [*g, "_b"]).withColumn("_to", F.col("_below") + F.sum("_c").over(order)).withColumn("_from", F.col("_to") - F.col("_c"))
    hit = place.drop("_below", "_in").join(values.select(*g, "_b", "_v", "_from", "_to"), [*g, "_b"]).filter((F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    weight = 1 - F.abs(F.col("_at") - F.col("_rank"))
    return hit.groupBy(*by, "share").agg(F.max("n").alias("n"), F.sum(weight * F.col("_v")).alias("quantile"))


def quantiles(df: DataFrame, *by: str, value: str, shares: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """n, mean, population deviation, extremes and exact linear-interpolated quantiles of finite values."""
    x = df.filter(F.col(value).isNotNull() & ~F.isnan(value))
    m = x.groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.min(value).alias("least"), F.max(value).alias("most"))
    q = exact_quantiles(x, list(by), value, shares)
    wide = q.groupBy(*by).agg(*(F.max(F.when(F.col("share") == s, F.col("quantile"))).alias(f"q{round(100 * s):02d}") for s in shares))
    return m.join(wide, list(by)) if by else m.crossJoin(wide)  # one row each


def geometric_mean(df: DataFrame, *by: str, value: str) -> DataFrame:
    """exp(mean log) of the positive values; 0 where there are none."""
    return df.groupBy(*by).agg(F.coalesce(F.exp(F.avg(F.when(F.col(value) > 0, F.log(F.when(F.col(value) > 0, F.col(value)))))), F.lit(0.0)).alias("geometric_mean"))


def coupling_profile(plan: DataFrame, source: str, mass: str) -> DataFrame:
    """Per source row of a coupling: mass, entropy of its normalised row, effective support exp(entropy)."""
    total = plan.filter(F.col(mass) > 0).groupBy(source).agg(F.sum(mass).alias("mass"), F.sum(F.col(mass) * F.log(mass)).alias("_s"), F.count("*").alias("support"))
    h = F.log("mass") - F.col("_s") / F.col("mass")
    return total.select(source, "mass", "support", h.alias("entropy"), F.exp(h).alias("effective_support"))


def confusion(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """Counts of label pairs with the share of the true label."""
    n = df.groupBy(truth, guess).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(truth)))


def majority_share(df: DataFrame, by: str, label: str) -> DataFrame:
    """The most frequent label of each group (ties: the smallest) and its share."""
    n = df.groupBy(by, label).agg(F.count("*").alias("n"))
    return n.groupBy(by).agg(F.min(F.struct((-F.col("n")).alias("m"), label)).alias("b"), F.sum("n").alias("all")).select(by, F.col(f"b.{label}").alias(label), (-F.col("b.m") / F.col("all")).alias("share"))


def rank_sum(cells: DataFrame, control: str) -> DataFrame:
    """Two-sided rank-sum test of every group against the control per measure, with tie-averaged ranks, tie and
    continuity correction in the normal approximation. Equal values are counted first; the control's counts below each value
    come from ranges of (measure, value), so that no task sorts or buffers a measure. Nulls rank last and are ties."""
    is_control = F.col("grp") == control
    n = cells.filter(F.col("grp").isNotNull()).groupBy("measure", "value", "grp").agg(F.count("*").alias("c"))
    per = n.groupBy("measure", "value").agg(F.coalesce(F.sum(F.when(is_control, F.col("c"))), F.lit(0)).alias("t2"), F.collect_list(F.when(~is_control, F.struct("grp", F.col("c").alias("t1")))).alias("own"))
    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("measure"), F.col("value").asc_nulls_last()]
    x = write_table(per.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "rank-sum")
    held = x.groupBy("measure", "_part").agg(F.sum("t2").alias("t"))  # a row per range and measure in it
    before = F.sum("t").over(W.partitionBy("measure").orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    offsets = held.select("measure", "_part", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.sum("t2").over(W.partitionBy("_part", "measure").orderBy(order[1]).rowsBetween(W.unboundedPreceding, 0)) - F.col("t2")
    # null measures never meet the control
    below = x.withColumn("inside", inside).join(offsets, ["measure", "_part"]).withColumn("below", (F.col("before") + F.col("inside")).cast("double"))
    t1, t2 = F.col("t1").cast("double"), F.col("t2").cast("double")
    cubes = lambda t: t * t * t - t
    u_ = below.select("measure", "below", "t2", F.inline("own")).groupBy("grp", "measure").agg(F.sum(t1).alias("n1"), F.sum(t1 * (F.col("below") + t2 / 2)).alias("u"), F.sum(cubes(t1 + t2) - cubes(t2)).alias("more"))
    c = x.groupBy("measure").agg(F.sum(t2).alias("n2"), F.sum(cubes(t2)).alias("ties"))
    s = u_.join(c, "measure").withColumn("ties", F.col("ties") + F.col("more"))
    n = F.col("n1") + F.col("n2")
    sd = F.sqrt(F.col("n1") * F.col("n2") / 12 * ((n + 1) - F.col("ties") / F.when(n > 1, n * (n - 1))))
    z = (F.abs(F.col("u") - F.col("n1") * F.col("n2") / 2) - 0.5) / F.when(sd > 0, sd)
    return s.select("grp", "measure", "u", z.alias("z")).withColumn("p", normal_two_sided(F.greatest("z", F.lit(0.0))))


def replicate_agreement(effects: DataFrame, least: int = 3) -> DataFrame:
    """Spearman correlation of effects between every two replicates over the pairs both have."""
    a = effects.select("grp", "measure", F.col("replicate").alias("a"), F.col("delta").alias("x"))
    b = effects.select("grp", "measure", F.col("replicate").alias("b"), F.col("delta").alias("y"))
    both = a.join(b, ["grp", "measure"]).filter("a < b").withColumns({"rx": average_rank("x", "a", "b"), "ry": average_rank("y", "a", "b")})
    return both.groupBy("a", "b").agg(F.count("*").alias("n"), pearson("rx", "ry").alias("spearman")).filter(F.col("n") >= least)


def permutation_null(df: DataFrame, identifier: str, x: str, y: str, draws: int, seed: int) -> DataFrame:
    """Observed Pearson correlation, and mean and deviation of it when ``y`` is dealt anew in a hashed order.

    Rows times draws are built: for effect tables, not for corpora."""
    w = W.partitionBy("b")
    rows = df.select(identifier, F.col(x).alias("x"), F.col(y).alias("y")).withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    hashed = F.md5(F.concat_ws(":", F.lit(str(seed)), "b", F.col(identifier).cast("string")))
    left = rows.withColumn("r", F.row_number().over(w.orderBy(identifier))).select("b", "r", "x")
    right = rows.withColumn("r", F.row_number().over(w.orderBy(hashed, identifier))).select("b", "r", "y")
    null = left.join(right, ["b", "r"]).groupBy("b").agg(pearson("x", "y").alias("c")).agg(F.avg("c").alias("null_mean"), F.stddev_samp("c").alias("null_sd"))
    return df.agg(pearson(x, y).alias("observed")).crossJoin(null)  # one row each


def wasserstein(df: DataFrame, by: str, side: str, value: str, steps: int = 100) -> DataFrame:
    """1-D distance of two sides (0 and 1): mean absolute difference of their quantiles at the middles of ``steps`` shares."""
    shares = tuple((i + 0.5) / steps for i in range(steps))
    q = exact_quantiles(df, [by, side], value, shares)
    a, b = (q.filter(F.col(side) == s).select(by, "share", F.col("quantile").alias(f"q{s}")) for s in (0, 1))
    return a.join(b, [by, "share"]).groupBy(by).agg((F.sum(F.abs(F.col("q0") - F.col("q1"))) / steps).alias("distance"))


def match_rate(ids: DataFrame, known: DataFrame, by: str) -> DataFrame:
    """Per sample: identifiers, those found in ``known`` (id), and the share."""
    k = known.select("id").distinct().withColumn("_hit", F.lit(1))
    return ids.join(k, "id", "left").groupBy(by).agg(F.count("*").alias("n"), F.count("_hit").alias("matched")).withColumn("share", ratio(F.col("matched").cast("double"), F.col("n").cast("double")))


def two_level_mean(df: DataFrame, keys: list[str], inner: str, value: str) -> DataFrame:
    """Mean over ``inner`` groups first, then over them with equal weights."""
    one = df.groupBy(*keys, inner).agg(F.avg(value).alias("_m"))
    return one.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("_m").alias("mean"))
