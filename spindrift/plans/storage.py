"""Sinks and the routed matrix stream: tables written whole, resumed, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import sinks
from ..sources.shared import shared_dir
from ..sources.tables import table
from ..streaming import matrices
from .registry import query


def order_totals(orders: DataFrame) -> DataFrame:
    return orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))


@query("SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 6) AS total FROM orders GROUP BY o_custkey")
def sink_published(spark: SparkSession, d: str) -> DataFrame:
    """SNK1, SNK4, SNK12: totals of all customers, staged, checked and committed, read back by the marker."""
    return sinks.publish(order_totals(table(spark, d, "orders")), shared_dir(spark, "published"), {"table": "orders", "measure": "totals"})


@query("SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 6) AS total FROM orders GROUP BY o_custkey")
def sink_resumed(spark: SparkSession, d: str) -> DataFrame:
    """STM4: the same in two goes: a third of the customers first, then all, of which only the missing ones are computed."""
    orders, folder, made_of = table(spark, d, "orders"), shared_dir(spark, "resumed"), {"table": "orders"}
    sinks.resume(orders.filter("o_custkey % 3 = 0"), folder, ["o_custkey"], order_totals, made_of)
    return sinks.resume(orders, folder, ["o_custkey"], order_totals, made_of)


@query("""WITH x AS (SELECT l_partkey, l_suppkey AS col, l_quantity AS value FROM lineitem), r AS (SELECT 'brand' AS output, p_partkey, p_brand AS target FROM part UNION ALL SELECT 'large', p_partkey, 'size ' || p_size FROM part WHERE p_size > 25)
SELECT output, target, col, round(sum(value), 6) AS value FROM x JOIN r ON l_partkey = p_partkey GROUP BY ALL""")
def src_routed_stream(spark: SparkSession, d: str) -> DataFrame:
    """SRC9, STM1: lineitem as gzip blocks of coordinates (part, supplier, quantity), streamed once into sums by brand and, for
    large parts, by size."""
    folder = shared_dir(spark, "coordinates")
    li = table(spark, d, "lineitem").select(F.col("l_partkey").alias("row"), F.col("l_suppkey").alias("col"), F.col("l_quantity").alias("value"))
    matrices.write_blocks(li, folder, 8)
    p = table(spark, d, "part")
    brand = p.select(F.lit("brand").alias("output"), F.col("p_partkey").alias("row"), F.col("p_brand").alias("target"))
    large = p.filter("p_size > 25").select(F.lit("large").alias("output"), F.col("p_partkey").alias("row"), F.concat(F.lit("size "), F.col("p_size").cast("string")).alias("target"))
    return matrices.routed(spark, folder, brand.unionByName(large))[0]
