"""Matrix queries: row = order key, column = part brand, value = summed quantity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import matrix
from ..sources.tables import table
from .effects import CELLS, CONTROL, cells
from .registry import query

X = "x AS (SELECT l_orderkey AS row, p_brand AS col, sum(l_quantity) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"
#: Rows that statistics are fitted on: order keys divisible by 3.
FIT = "f AS (SELECT DISTINCT row FROM x WHERE row % 3 = 0)"


def x_of(spark: SparkSession, d: str) -> DataFrame:
    li, p = table(spark, d, "lineitem"), table(spark, d, "part")
    j = li.join(p, li.l_partkey == p.p_partkey)
    return j.groupBy(F.col("l_orderkey").alias("row"), F.col("p_brand").alias("col")).agg(F.sum("l_quantity").alias("value"))


def fit_rows(x: DataFrame) -> DataFrame:
    return x.filter("row % 3 = 0").select("row").distinct()


V = "round(value, 6) + 0.0 AS value"


@query(f"WITH {X} SELECT col, count(*) AS n, round(sum(value), 6) AS total FROM x WHERE col IN (SELECT col FROM x GROUP BY col HAVING count_if(value > 0) >= 100) GROUP BY col")
def mat_min_cells_filter(spark: SparkSession, d: str) -> DataFrame:
    return matrix.frequent_columns(x_of(spark, d), 100).groupBy("col").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query(f"WITH {X} SELECT row, col, round(ln(1 + coalesce(value / nullif(sum(value) OVER (PARTITION BY row), 0), 0) * 10000), 6) + 0.0 AS value FROM x")
def mat_cp10k_log1p(spark: SparkSession, d: str) -> DataFrame:
    return matrix.size_normalised(x_of(spark, d))


@query(f"WITH {X} SELECT row, col, round(ln(1 + value) - sum(ln(1 + value)) OVER (PARTITION BY row) / 25, 6) + 0.0 AS value FROM x")
def mat_clr(spark: SparkSession, d: str) -> DataFrame:
    return matrix.centred_log_ratio(x_of(spark, d), 25)


@query(f"WITH {X}, t AS (SELECT o_orderkey AS row, o_totalprice AS total FROM orders), m AS (SELECT quantile_cont(greatest(total, 1.0), 0.5) AS median FROM t) SELECT row, col, round(ln(1 + value / greatest(total, 1.0) * median), 6) + 0.0 AS value FROM x JOIN t USING (row), m")
def mat_size_factor(spark: SparkSession, d: str) -> DataFrame:
    totals = table(spark, d, "orders").select(F.col("o_orderkey").alias("row"), F.col("o_totalprice").alias("total"))
    return matrix.size_factor(x_of(spark, d), totals)


@query(f"WITH {X}, {FIT}, df AS (SELECT col, count(*) AS df FROM x WHERE value > 0 AND row IN (SELECT row FROM f) GROUP BY col) SELECT row, col, round(ln(1 + ln(1 + (SELECT count(*) FROM f) / df) / count(*) OVER (PARTITION BY row) * 10000), 6) AS value FROM x JOIN df USING (col) WHERE value > 0")
def mat_tfidf_fit_on_train(spark: SparkSession, d: str) -> DataFrame:
    x = x_of(spark, d)
    return matrix.tfidf(x, fit_rows(x))


@query(f"WITH {X}, {FIT}, s AS (SELECT col, avg(value) AS m, stddev_pop(value) AS s FROM x WHERE row IN (SELECT row FROM f) GROUP BY col) SELECT row, col, round((value - m) / CASE WHEN s > 1e-12 THEN s ELSE 1 END, 6) + 0.0 AS value FROM x JOIN s USING (col)")
def mat_zscore_fit_on_train(spark: SparkSession, d: str) -> DataFrame:
    x = x_of(spark, d)
    return matrix.standardise(x, fit_rows(x))


@query(f"WITH {X}, s AS (SELECT col, min(value) AS lo, max(value) AS hi FROM x GROUP BY col) SELECT row, col, round(coalesce((value - lo) / nullif(hi - lo, 0), 0), 6) + 0.0 AS value FROM x JOIN s USING (col)")
def mat_minmax(spark: SparkSession, d: str) -> DataFrame:
    return matrix.minmax(x_of(spark, d))


@query(f"WITH {X}, t AS (SELECT unnest(['Brand#11', 'Brand#12', 'Brand#99']) AS col) SELECT row, t.col, round(coalesce(value, 0), 6) + 0.0 AS value FROM (SELECT DISTINCT row FROM x) CROSS JOIN t LEFT JOIN x USING (row, col)")
def mat_reindex_zero_fill(spark: SparkSession, d: str) -> DataFrame:
    x = x_of(spark, d)
    target = spark.createDataFrame([("Brand#11",), ("Brand#12",), ("Brand#99",)], "col string")
    return matrix.reindex(x, x.select("row").distinct(), target)


CAL = "c AS (SELECT l_returnflag AS col, l_quantity AS predicted, l_extendedprice / 1000 AS observed, l_linenumber = 1 AS is_control FROM lineitem), s AS (SELECT col, count(*) AS n, covar_pop(predicted, observed) / var_pop(predicted) AS slope, avg(observed) AS mo, avg(predicted) AS mp, stddev_pop(observed) / stddev_pop(predicted) AS scale FROM c WHERE is_control GROUP BY col)"


def calibration_input(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_returnflag").alias("col"), F.col("l_quantity").alias("predicted"), (F.col("l_extendedprice") / 1000).alias("observed"), (F.col("l_linenumber") == 1).alias("is_control"))


@query(f"WITH {CAL} SELECT col, n, round(scale, 6) AS scale FROM s")
def mat_positive_scale(spark: SparkSession, d: str) -> DataFrame:
    return matrix.calibration(calibration_input(spark, d)).select("col", "n", "scale")


@query(f"WITH {CAL} SELECT col, n, round(slope, 6) + 0.0 AS slope, round(mo - slope * mp, 6) + 0.0 AS intercept FROM s")
def mat_affine_calibration(spark: SparkSession, d: str) -> DataFrame:
    return matrix.calibration(calibration_input(spark, d)).select("col", "n", "slope", "intercept")


@query("WITH x AS (SELECT l_orderkey AS row, p_brand AS col, sum(l_quantity) AS value, sum(l_discount) AS velocity FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL), s AS (SELECT *, sum(value) OVER (PARTITION BY row) AS t, sum(velocity) OVER (PARTITION BY row) AS dt FROM x) SELECT row, col, round(10000 * (velocity * t - value * dt) / (t * t) / (1 + 10000 * value / t), 6) + 0.0 AS value FROM s")
def mat_velocity_chain_rule(spark: SparkSession, d: str) -> DataFrame:
    li, p = table(spark, d, "lineitem"), table(spark, d, "part")
    x = li.join(p, li.l_partkey == p.p_partkey).groupBy(F.col("l_orderkey").alias("row"), F.col("p_brand").alias("col")).agg(F.sum("l_quantity").alias("value"), F.sum("l_discount").alias("velocity"))
    return matrix.log_velocity(x)


@query(f"WITH {X}, w AS (SELECT o_custkey AS target, o_orderkey AS row, o_totalprice AS weight FROM orders), t AS (SELECT target, sum(weight) AS total FROM w GROUP BY target) SELECT target, col, round(sum(weight * value) / total, 6) AS value FROM w JOIN x USING (row) JOIN t USING (target) GROUP BY target, col, total")
def bary_weighted_mean(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "orders").select(F.col("o_custkey").alias("target"), F.col("o_orderkey").alias("row"), F.col("o_totalprice").alias("weight"))
    return matrix.weighted_mean(w, x_of(spark, d))


@query(f"WITH {CELLS}, f AS (SELECT * FROM cells WHERE replicate <> 'BUILDING'), b AS (SELECT measure, avg(value) AS base FROM f WHERE grp = '5-LOW' GROUP BY measure) SELECT grp, measure, count(*) AS n, round(sum(value - base) / (count(*) + 1.0), 6) + 0.0 AS effect FROM f JOIN b USING (measure) WHERE grp <> '5-LOW' GROUP BY grp, measure HAVING count(*) >= 20")
def ridge_onehot_effect(spark: SparkSession, d: str) -> DataFrame:
    return matrix.onehot_ridge(cells(spark, d), "BUILDING", 20, 1.0, CONTROL)
