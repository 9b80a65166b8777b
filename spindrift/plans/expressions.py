"""Queries of names, expressions and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import maths, strings
from ..operators import sets
from ..sources.tables import table
from .matrices import X, fit_rows, x_of
from .registry import query


@query("SELECT p_partkey, upper(trim(regexp_replace(regexp_replace(trim(p_type), '(STEEL|COPPER)$', '', 'i'), ' (BRUSHED|PLATED)$', '', 'i'))) AS stem, regexp_replace(p_type, '[^\\p{L}\\p{N}_-]', '_', 'g') AS safe, split_part(p_brand, '#', 1) AS head, split_part(p_brand, '#', -1) AS tail FROM part")
def str_clean_names(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select("p_partkey", strings.strip_suffixes(F.col("p_type"), ["STEEL|COPPER", r"\x20(?:BRUSHED|PLATED)"]).alias("stem"), strings.safe_name(F.col("p_type")).alias("safe"), F.substring_index("p_brand", "#", 1).alias("head"), F.substring_index("p_brand", "#", -1).alias("tail"))


@query("WITH x AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN ' NaN ' WHEN 1 THEN '' WHEN 2 THEN 'inf' WHEN 3 THEN '1e' || (event_id % 3) WHEN 4 THEN value::VARCHAR ELSE ' Yes' END AS t FROM events) SELECT event_id, CASE WHEN lower(trim(t)) NOT IN ('', 'nan', 'none', 'na', '<na>', 'null') THEN trim(t) END AS text, round(CASE WHEN regexp_full_match(trim(t), '[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?') THEN try_cast(trim(t) AS DOUBLE) END, 6) AS number FROM x")
def str_missing_and_numbers(spark: SparkSession, d: str) -> DataFrame:
    m, v = F.col("event_id") % 6, F.col("value").cast("string")
    t = F.when(m == 0, " NaN ").when(m == 1, "").when(m == 2, "inf").when(m == 3, F.concat(F.lit("1e"), F.col("event_id") % 3)).when(m == 4, v).otherwise(" Yes")
    return table(spark, d, "events").select("event_id", strings.missing_to_null(t).alias("text"), strings.strict_number(t).alias("number"))


@query("SELECT s_suppkey, CASE WHEN n = 0 THEN key ELSE key || '-' || n END AS name_unique FROM (SELECT s_suppkey, 'nation' || s_nationkey AS key, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS n FROM supplier)")
def str_distinct_names(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").withColumn("key", F.concat(F.lit("nation"), "s_nationkey"))
    return strings.distinct_names(s, "key", "s_suppkey").select("s_suppkey", "name_unique")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(0.5 * (l_tax * l_quantity - l_discount * 10), 6) + 0.0 AS relaxed, round(1.0 - 0.3 * l_quantity, 6) AS du, round(0.3 * l_quantity - 0.1 * l_linenumber, 6) AS ds, round(ln(1 + greatest(l_discount - 0.05, 0) * 100), 6) AS logged, round(2 * exp(least(greatest(l_tax * 100, 1), 5)), 6) AS rate, round(least(l_linenumber / 4.0, 1), 6) AS ramp, round(CASE WHEN l_linenumber < 3 THEN (l_linenumber + 1) / 3.0 ELSE 0.5 * (1 + cos(3.141592653589793 * least((l_linenumber - 3) / 5.0, 1))) END, 6) + 0.0 AS schedule, round(CASE WHEN l_quantity <= 10 THEN 0 WHEN l_quantity <= 20 THEN (l_quantity - 10) * 0.1 WHEN l_quantity <= 40 THEN 1 + (l_quantity - 20) * 0.05 ELSE 2 END, 6) + 0.0 AS piecewise FROM lineitem")
def math_kinetics(spark: SparkSession, d: str) -> DataFrame:
    q, n, lit = F.col("l_quantity"), F.col("l_linenumber"), F.lit
    x = table(spark, d, "lineitem").withColumn("_s", maths.splicing(q, n, lit(1.0), lit(0.3), lit(0.1)))
    return x.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", maths.relaxation(q, lit(10.0), lit(0.5), F.col("l_tax"), F.col("l_discount")).alias("relaxed"), F.col("_s.du").alias("du"), F.col("_s.ds").alias("ds"),
        maths.clipped_log1p(F.col("l_discount") - 0.05, 100.0).alias("logged"), maths.clipped_exp(F.col("l_tax") * 100, 1.0, 5.0, 2.0).alias("rate"), maths.ramp(n, 4).alias("ramp"),
        maths.warm_cosine(n, 3, 8).alias("schedule"), maths.interpolated(q, [(10, 0), (20, 1), (40, 2)]).alias("piecewise"),
    )


@query("SELECT o_orderkey, unnest(list_filter([CASE WHEN o_totalprice > 200000 THEN 'large' END, CASE WHEN o_orderstatus = 'F' THEN 'final' END, CASE WHEN o_orderpriority = '1-URGENT' THEN 'urgent' END], lambda x: x IS NOT NULL)) AS subset FROM orders")
def set_rows_per_subset(spark: SparkSession, d: str) -> DataFrame:
    subsets = {"large": F.col("o_totalprice") > 200000, "final": F.col("o_orderstatus") == "F", "urgent": F.col("o_orderpriority") == "1-URGENT"}
    return sets.per_subset(table(spark, d, "orders"), subsets).select("o_orderkey", "subset")


@query("WITH n AS (SELECT c_custkey, 'new' AS state FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey + 1000000, 'new' FROM customer WHERE c_custkey % 7 = 0) SELECT c_custkey, c_mktsegment AS state FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM n) UNION ALL SELECT * FROM n")
def set_upsert(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    new = c.filter("c_custkey % 3 = 0").select("c_custkey", F.lit("new").alias("state")).union(c.filter("c_custkey % 7 = 0").select(F.col("c_custkey") + 1000000, F.lit("new")))
    return sets.upsert(c.select("c_custkey", F.col("c_mktsegment").alias("state")), new, ["c_custkey"])


@query("WITH a AS (SELECT DISTINCT c_custkey AS k FROM customer), b AS (SELECT DISTINCT o_custkey AS k FROM orders) SELECT k, 'left' AS side FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT k, 'right' FROM b WHERE k NOT IN (SELECT k FROM a)")
def set_key_differences(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    return sets.key_differences(a, table(spark, d, "orders").select(F.col("o_custkey").alias("k")), ["k"])


@query(f"WITH {X}, s AS (SELECT col, var_pop(value) / avg(value) AS dispersion FROM x WHERE row % 3 = 0 GROUP BY col), t AS (SELECT col FROM s ORDER BY dispersion DESC, col LIMIT 5) SELECT col FROM t UNION SELECT 'Brand#11'")
def mat_variable_columns(spark: SparkSession, d: str) -> DataFrame:
    x = x_of(spark, d)
    return sets.variable_columns(x, fit_rows(x), 5, spark.createDataFrame([("Brand#11",)], "col string"))


@query("SELECT bool_or(abs(l_quantity - round_even(l_quantity, 0)) > 1e-6) AS has_fractions FROM lineitem")
def mat_has_fractions(spark: SparkSession, d: str) -> DataFrame:
    return sets.has_fractions(table(spark, d, "lineitem"), "l_quantity")


@query("SELECT c_custkey FROM customer ORDER BY md5('5:' || c_custkey), c_custkey LIMIT 100")
def split_nested_subset(spark: SparkSession, d: str) -> DataFrame:
    return sets.nested_subset(table(spark, d, "customer").select("c_custkey"), "c_custkey", 100, 5)
