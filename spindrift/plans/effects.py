"""Effect-table queries: group = order priority, replicate = market segment, measure = return flag and line status."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import normal_two_sided_log, pearson
from ..operators import effects, metrics
from ..sources.tables import table
from .registry import query

CONTROL = "5-LOW"


def cells(spark: SparkSession, d: str) -> DataFrame:
    """One row per line item with group, replicate, measure, value and cognate value: an inner join by keys."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", "l_extendedprice", "l_discount")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    x = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
    return x.select(F.col("o_orderpriority").alias("grp"), F.col("c_mktsegment").alias("replicate"), F.concat("l_returnflag", "l_linestatus").alias("measure"), F.log1p("l_extendedprice").alias("value"), F.col("l_discount").alias("cognate"))


CELLS = """cells AS (SELECT o_orderpriority AS grp, c_mktsegment AS replicate, l_returnflag || l_linestatus AS measure, ln(1 + l_extendedprice) AS value, l_discount AS cognate
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""
EFFECTS = CELLS + """, st AS (SELECT grp, replicate, measure, count(*) AS n, avg(value) AS m, var_samp(value) AS v, avg(cognate) AS c FROM cells GROUP BY ALL),
eff AS (SELECT a.grp, a.replicate, a.measure, a.n AS n_group, b.n AS n_control, a.m - b.m AS delta, a.c - b.c AS delta_cognate, sqrt(a.v / a.n + b.v / b.n) AS se
  FROM st a JOIN st b ON a.replicate = b.replicate AND a.measure = b.measure AND b.grp = '5-LOW' WHERE a.grp <> '5-LOW' AND a.n >= 2 AND b.n >= 2)"""
POOLED = EFFECTS + """, pz AS (SELECT grp, measure, avg(delta) AS delta, avg(delta_cognate) AS delta_cognate, count(DISTINCT replicate) AS n_replicates, sqrt(sum(se * se)) / count(se) AS se FROM eff GROUP BY ALL),
pool0 AS (SELECT *, CASE WHEN se <> 0 THEN delta / se END AS z, 1 / (1 + 0.5 * abs(CASE WHEN se <> 0 THEN delta / se END) / sqrt(2)) AS t FROM pz),
pl AS (SELECT * EXCLUDE (t), ln(t) - z * z / 2 - 1.26551223 + t * (1.00002368 + t * (0.37409196 + t * (0.09678418 + t * (-0.18628806 + t * (0.27886807 + t * (-1.13520398 + t * (1.48851587 + t * (-0.82215223 + t * 0.17087277)))))))) AS log_p FROM pool0),
pool AS (SELECT *, least(1.0, exp(log_p)) AS p FROM pl)"""
QVALUES = POOLED + """, rk AS (SELECT *, row_number() OVER (ORDER BY p ASC NULLS LAST) AS r, count(p) OVER () AS n FROM pool),
qv AS (SELECT *, CASE WHEN p IS NOT NULL THEN least(1.0, min(p * n / r) OVER (ORDER BY p DESC NULLS LAST, r DESC ROWS UNBOUNDED PRECEDING)) END AS q FROM rk)"""
#: Predictions of the metric queries: the effect in one replicate against the mean of the pair over all.
PAIRS = EFFECTS + ", pp AS (SELECT e.grp, e.measure, e.replicate, m.delta AS predicted, e.delta AS observed FROM eff e JOIN (SELECT grp, measure, avg(delta) AS delta FROM eff GROUP BY ALL) m USING (grp, measure))"


def r(*names: str) -> str:
    return ", ".join(f"round({n}, 6) + 0.0 AS {n.split('.')[-1]}" for n in names)


def effects_of(spark: SparkSession, d: str) -> DataFrame:
    return effects.group_contrast(cells(spark, d), CONTROL)


def pairs(spark: SparkSession, d: str) -> DataFrame:
    e = effects_of(spark, d)
    m = e.groupBy("grp", "measure").agg(F.avg("delta").alias("predicted"))
    return e.join(m, ["grp", "measure"]).select("grp", "measure", "replicate", "predicted", F.col("delta").alias("observed"))


@query(f"WITH {EFFECTS} SELECT grp, replicate, measure, n_group, n_control, {r('delta', 'delta_cognate', 'se')} FROM eff")
def effects_within_group_contrast(spark: SparkSession, d: str) -> DataFrame:
    return effects_of(spark, d)


@query(f"WITH {CELLS}, c AS (SELECT grp, replicate, count(*) AS n FROM cells WHERE grp <> '5-LOW' GROUP BY ALL HAVING count(*) >= 20) SELECT grp, count(*) AS n_replicates FROM c GROUP BY grp HAVING count(*) >= 3")
def effects_sufficient_groups(spark: SparkSession, d: str) -> DataFrame:
    return effects.sufficient_groups(cells(spark, d), CONTROL, 20, 3)


@query(f"WITH {POOLED} SELECT grp, measure, n_replicates, {r('delta', 'delta_cognate', 'se', 'z', 'p')} FROM pool")
def effects_pooled_pairs(spark: SparkSession, d: str) -> DataFrame:
    return effects.pooled_pairs(effects_of(spark, d))


@query(f"WITH {QVALUES} SELECT grp, measure, {r('p', 'q')} FROM qv")
def effects_bh_qvalue(spark: SparkSession, d: str) -> DataFrame:
    return effects.bh_qvalues(effects.pooled_pairs(effects_of(spark, d))).select("grp", "measure", "p", "q")


FLAGS = QVALUES + """, cut AS (SELECT quantile_cont(abs(delta), 0.75) AS hi, quantile_cont(abs(delta_cognate), 0.5) AS lo FROM qv),
fl AS (SELECT eff.*, coalesce(q < 0.05, false) AS in_significant, coalesce(abs(qv.delta) >= hi AND abs(qv.delta_cognate) <= lo, false) AS in_decoupled FROM eff LEFT JOIN qv USING (grp, measure), cut)"""


@query(f"WITH {FLAGS} SELECT grp, replicate, measure, in_significant, in_decoupled, {r('delta')} FROM fl")
def effects_subset_flags(spark: SparkSession, d: str) -> DataFrame:
    e = effects_of(spark, d)
    return effects.subset_flags(e, effects.pooled_pairs(e)).select("grp", "replicate", "measure", "in_significant", "in_decoupled", "delta")


@query(f"WITH {FLAGS}, ok AS (SELECT grp FROM (SELECT grp, replicate FROM cells WHERE grp <> '5-LOW' GROUP BY ALL HAVING count(*) >= 20) GROUP BY grp HAVING count(*) >= 3) SELECT grp, measure, count(*) AS n_replicates, bool_or(in_significant) AS in_significant, bool_or(in_decoupled) AS in_decoupled, {r('avg(delta)').replace('AS avg(delta)', 'AS delta')} FROM fl SEMI JOIN ok USING (grp) GROUP BY ALL")
def effects_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: join, contrast, design filter, pooling, false-discovery control and flags in one plan."""
    c = cells(spark, d)
    e = effects.group_contrast(c, CONTROL)
    flagged = effects.subset_flags(e, effects.pooled_pairs(e)).join(effects.sufficient_groups(c, CONTROL, 20, 3), "grp", "left_semi")
    return flagged.groupBy("grp", "measure").agg(F.count("*").alias("n_replicates"), F.bool_or("in_significant").alias("in_significant"), F.bool_or("in_decoupled").alias("in_decoupled"), F.avg("delta").alias("delta"))


#: Average-tie ranks and the guarded correlation in SQL.
RANKED = PAIRS + """, rr AS (SELECT *, rank() OVER (PARTITION BY {k} ORDER BY predicted) + (count(*) OVER (PARTITION BY {k}, predicted) - 1) / 2.0 AS rp,
  rank() OVER (PARTITION BY {k} ORDER BY observed) + (count(*) OVER (PARTITION BY {k}, observed) - 1) / 2.0 AS ro FROM pp)"""
CORR = "CASE WHEN count(*) >= 3 AND stddev_pop({a}) * stddev_pop({b}) > 1e-12 THEN covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})) END"
SUITE = f"""SELECT {{k}}, count(*) AS n, round({CORR.format(a='rp', b='ro')}, 6) + 0.0 AS spearman, round({CORR.format(a='predicted', b='observed')}, 6) + 0.0 AS pearson,
 CASE WHEN count(*) >= 3 THEN round(avg(abs(predicted - observed)), 6) END AS mae, CASE WHEN count(*) >= 3 AND stddev_pop(observed) <> 0 THEN round(sqrt(avg((predicted - observed) ^ 2)) / stddev_pop(observed), 6) END AS nrmse,
 CASE WHEN count(*) >= 3 THEN round(avg((sign(predicted) = sign(observed))::INT), 6) END AS sign_accuracy FROM rr GROUP BY {{k}}"""


@query(f"WITH {RANKED.format(k='measure')} {SUITE.format(k='measure')}")
def effects_metric_suite(spark: SparkSession, d: str) -> DataFrame:
    return metrics.metric_suite(pairs(spark, d), "measure")


@query(f"WITH {RANKED.format(k='grp')} SELECT grp, n, spearman, pearson FROM ({SUITE.format(k='grp')})")
def effects_per_group_correlation(spark: SparkSession, d: str) -> DataFrame:
    return metrics.metric_suite(pairs(spark, d), "grp").select("grp", "n", "spearman", "pearson")


@query(f"WITH {RANKED.format(k='replicate')} SELECT replicate, spearman FROM ({SUITE.format(k='replicate')})")
def effects_spearman(spark: SparkSession, d: str) -> DataFrame:
    return metrics.metric_suite(pairs(spark, d), "replicate").select("replicate", "spearman")


@query(f"WITH {PAIRS} SELECT grp, count(*) AS n, round(sum(predicted * observed) / sqrt(sum(predicted ^ 2) * sum(observed ^ 2)), 6) + 0.0 AS cosine FROM pp GROUP BY grp")
def effects_response_cosine(spark: SparkSession, d: str) -> DataFrame:
    return metrics.response_cosine(pairs(spark, d), "grp").select("grp", "n", "cosine")


@query(f"WITH {PAIRS} SELECT grp, round(sqrt(sum(predicted ^ 2)), 6) AS norm_predicted, round(sqrt(sum(observed ^ 2)), 6) AS norm_observed, round(sqrt(sum(predicted ^ 2)) / sqrt(sum(observed ^ 2)), 6) AS norm_ratio FROM pp GROUP BY grp")
def effects_norm_calibration(spark: SparkSession, d: str) -> DataFrame:
    return metrics.response_cosine(pairs(spark, d), "grp").select("grp", "norm_predicted", "norm_observed", "norm_ratio")


@query(f"WITH {PAIRS} SELECT measure, round(sum(predicted * observed) / sum(observed ^ 2), 6) + 0.0 AS slope FROM pp GROUP BY measure")
def effects_origin_slope(spark: SparkSession, d: str) -> DataFrame:
    return metrics.origin_slope(pairs(spark, d), "measure")


@query(f"WITH {CELLS}, s AS (SELECT grp, measure, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM cells GROUP BY ALL) SELECT a.grp, a.measure, a.n, round(a.m - b.m, 6) + 0.0 AS delta, round((a.m - b.m) / sqrt((a.v + b.v) / 2), 6) + 0.0 AS cohens_d FROM s a JOIN s b ON a.measure = b.measure AND b.grp = '5-LOW' WHERE a.grp <> '5-LOW'")
def effects_cohens_d(spark: SparkSession, d: str) -> DataFrame:
    return effects.cohens_d(cells(spark, d), CONTROL)


@query(f"WITH {CELLS} SELECT measure, round(CASE WHEN stddev_pop(value) * stddev_pop(cognate) > 1e-12 THEN covar_pop(value, cognate) / (stddev_pop(value) * stddev_pop(cognate)) END, 6) + 0.0 AS correlation FROM cells GROUP BY measure")
def effects_cognate_correlation(spark: SparkSession, d: str) -> DataFrame:
    return cells(spark, d).groupBy("measure").agg(pearson("value", "cognate").alias("correlation"))


@query(f"WITH {POOLED} SELECT grp, measure, {r('z', 'p')}, round(log_p / ln(10), 6) + 0.0 AS log10_p FROM pool")
def effects_two_sided_p(spark: SparkSession, d: str) -> DataFrame:
    x = effects.pooled_pairs(effects_of(spark, d))
    return x.select("grp", "measure", "z", "p", (normal_two_sided_log("z") / math.log(10)).alias("log10_p"))
