"""Interval, name and split queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import intervals, names, splits
from ..sources.tables import table
from .registry import query

IV = "iv AS (SELECT event_id AS id, user_id AS chrom, CAST(floor(epoch(ts)) AS BIGINT) AS start, CAST(floor(epoch(ts)) + 3600 * (1 + floor(value) % 4) AS BIGINT) AS \"end\" FROM events)"


def iv_of(spark: SparkSession, d: str) -> DataFrame:
    start = F.unix_timestamp("ts")
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("chrom"), start.alias("start"), (start + 3600 * (1 + F.floor("value") % 4)).cast("long").alias("end"))


@query(f'WITH {IV}, m AS (SELECT *, CASE WHEN start > coalesce(max("end") OVER (PARTITION BY chrom ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), start - 1) THEN 1 ELSE 0 END AS nw FROM iv), b AS (SELECT *, sum(nw) OVER (PARTITION BY chrom ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS block FROM m) SELECT chrom, min(start) AS start, max("end") AS "end", count(*) AS n FROM b GROUP BY chrom, block')
def iv_merge_union(spark: SparkSession, d: str) -> DataFrame:
    return intervals.merge_union(iv_of(spark, d))


@query(f'WITH {IV} SELECT a.chrom, a.id AS id_a, b.id AS id_b, round(exp(-abs((a.start + a."end") / 2.0 - (b.start + b."end") / 2.0) / 5000), 6) AS weight FROM iv a JOIN iv b ON a.chrom = b.chrom AND a.id < b.id AND a.start < b."end" AND b.start < a."end"')
def iv_overlap_weighted(spark: SparkSession, d: str) -> DataFrame:
    return intervals.overlap_pairs(iv_of(spark, d), 14400, 5000.0)


@query(f'WITH {IV}, m AS (SELECT chrom, id, (start + "end") / 2.0 AS mid FROM iv), p AS (SELECT a.chrom, a.id AS id_a, b.id AS id_b, exp(-abs(a.mid - b.mid) / 5000) AS w FROM m a JOIN m b ON a.chrom = b.chrom AND a.id <> b.id AND abs(a.mid - b.mid) <= 20000) SELECT chrom, id_a, id_b, round(w / sum(w) OVER (PARTITION BY id_a), 6) AS weight FROM p')
def iv_band_join_decay(spark: SparkSession, d: str) -> DataFrame:
    return intervals.band_pairs(iv_of(spark, d), 20000, 5000.0)


@query("WITH n AS (SELECT p_partkey AS pos, p_type AS name, 1 AS priority FROM part UNION ALL SELECT p_partkey, p_brand, 2 FROM part), a AS (SELECT upper(regexp_replace(name, '[^A-Za-z0-9]', '', 'g')) AS alias, pos, priority FROM n) SELECT alias, arg_min(pos, (priority, pos)) AS pos FROM a WHERE alias NOT IN ('', 'NAN') GROUP BY alias")
def name_alias_lookup(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    pos = F.col("p_partkey").alias("pos")
    return names.alias_lookup(p.select(pos, F.col("p_type").alias("name"), F.lit(1).alias("priority")).union(p.select(pos, F.col("p_brand"), F.lit(2))))


@query("WITH k AS (SELECT s_name AS id FROM supplier), f AS (SELECT 0 AS format, 'supplier' || l_suppkey AS name FROM lineitem UNION ALL SELECT 1, 'Supplier#' || lpad(l_suppkey::VARCHAR, 9, '0') FROM lineitem UNION ALL SELECT 2, 'Supplier#' || l_suppkey FROM lineitem) SELECT format::INT AS format, count(*) AS n FROM f WHERE name IN (SELECT id FROM k) GROUP BY format ORDER BY n DESC, format LIMIT 1")
def name_best_format(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("id"))
    known = table(spark, d, "supplier").select(F.col("s_name").alias("id"))
    formats = [F.concat(F.lit("supplier"), "id"), F.concat(F.lit("Supplier#"), F.lpad("id", 9, "0")), F.concat(F.lit("Supplier#"), "id")]
    return names.best_format(ids, known, formats)


@query("SELECT p_partkey, CASE WHEN p_retailprice IS NULL THEN 'no price' WHEN p_size < 5 THEN 'too small' WHEN p_type LIKE '%PROMO%' THEN 'promotion' WHEN p_size > 45 THEN 'too large' ELSE 'eligible' END AS reason FROM part")
def map_eligibility_reason(spark: SparkSession, d: str) -> DataFrame:
    tests = [("no price", F.col("p_retailprice").isNull()), ("too small", F.col("p_size") < 5), ("promotion", F.col("p_type").contains("PROMO")), ("too large", F.col("p_size") > 45)]
    return table(spark, d, "part").select("p_partkey", names.first_reason(tests, "eligible").alias("reason"))


def h(i: str, seed: int) -> str:
    return f"('0x' || substr(md5('{seed}:' || {i}), 1, 13))::BIGINT / 4503599627370496.0"


@query(f"SELECT c_custkey, {h('c_custkey', 7)} < 0.2 AS selected FROM customer")
def split_hash_threshold(spark: SparkSession, d: str) -> DataFrame:
    return splits.hash_split(table(spark, d, "customer").select("c_custkey"), "c_custkey", 0.2, 7)


@query(f"SELECT c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {h('c_custkey', 7)}, c_custkey) <= floor(0.2 * count(*) OVER (PARTITION BY c_mktsegment) + 0.5) AS selected FROM customer")
def split_stratified_exact(spark: SparkSession, d: str) -> DataFrame:
    return splits.stratified_split(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", "c_mktsegment", 0.2, 7).select("c_custkey", "selected")


@query(f"WITH x AS (SELECT c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {h('c_custkey', 3)}, c_custkey) AS r, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer), y AS (SELECT *, round_even(n * 0.2, 0) AS t, round_even(n * 0.1, 0) AS v FROM x) SELECT c_custkey, CASE WHEN r <= t THEN 'test' WHEN r <= t + v THEN 'validation' WHEN (r - t - v) % 2 = 1 THEN 'train_a' ELSE 'train_b' END AS part FROM y")
def split_three_way(spark: SparkSession, d: str) -> DataFrame:
    return splits.three_way_split(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", "c_mktsegment", 0.1, 0.2, 3).select("c_custkey", "part")


@query("SELECT c_mktsegment, count(*) AS n, sum(('0x' || substr(md5(c_custkey::VARCHAR), 1, 13))::BIGINT)::VARCHAR AS digest FROM customer GROUP BY c_mktsegment")
def split_digest(spark: SparkSession, d: str) -> DataFrame:
    return splits.split_digest(table(spark, d, "customer"), "c_custkey", "c_mktsegment")
