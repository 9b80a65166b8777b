"""Run-table queries: arm = event type, seed = user modulo 12, metric = value; and bootstrap, curves, distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import names, runs
from ..sources.tables import table
from .registry import query

RUNS = "runs AS (SELECT event_type AS arm, user_id % 12 AS seed, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 5 AS cell, event_id, value AS metric, ts FROM events)"
CELLS = RUNS + ", c AS (SELECT arm, seed, cell, avg(metric) AS metric FROM runs GROUP BY ALL)"


def runs_of(spark: SparkSession, d: str) -> DataFrame:
    cell = (F.get_json_object("props", "$.k").cast("int") % 5).alias("cell")
    return table(spark, d, "events").select(F.col("event_type").alias("arm"), (F.col("user_id") % 12).alias("seed"), cell, "event_id", F.col("value").alias("metric"), "ts")


def cells_of(spark: SparkSession, d: str) -> DataFrame:
    return runs_of(spark, d).groupBy("arm", "seed", "cell").agg(F.avg("metric").alias("metric"))


@query(f"WITH {RUNS} SELECT arm, cell, count(*) AS n, count(DISTINCT seed) AS n_seeds, count_if(metric IS NULL)::BIGINT AS bad, round(avg(metric), 6) AS mean, round(stddev_samp(metric), 6) AS sd FROM runs GROUP BY arm, cell")
def runs_aggregate_by_config(spark: SparkSession, d: str) -> DataFrame:
    return runs.aggregate(runs_of(spark, d), ["arm", "cell"], "metric")


DELTAS = CELLS + ", dl AS (SELECT a.arm, count(a.metric - b.metric) AS n, avg(a.metric - b.metric) AS mean_delta, stddev_samp(a.metric - b.metric) AS sd_delta, count_if(a.metric < b.metric)::BIGINT AS wins FROM c a JOIN c b USING (seed, cell) WHERE b.arm = 'view' AND a.arm <> 'view' GROUP BY a.arm)"


@query(f"WITH {DELTAS} SELECT arm, n, round(mean_delta, 6) + 0.0 AS mean_delta, round(sd_delta, 6) AS sd_delta, wins FROM dl")
def runs_paired_delta_vs_baseline(spark: SparkSession, d: str) -> DataFrame:
    return runs.paired_deltas(cells_of(spark, d), "arm", ["seed", "cell"], "metric", "view")


@query(f"WITH {DELTAS} SELECT arm, round(mean_delta, 6) + 0.0 AS mean_delta, wins FROM dl ORDER BY dl.mean_delta, wins DESC, arm LIMIT 1")
def runs_winner(spark: SparkSession, d: str) -> DataFrame:
    deltas = runs.paired_deltas(cells_of(spark, d), "arm", ["seed", "cell"], "metric", "view")
    return runs.winner(deltas, "arm").select("arm", "mean_delta", "wins")


@query(f"WITH {RUNS} SELECT seed, round(avg(metric), 6) AS mean, round(stddev_samp(metric), 6) AS std, round(min(metric), 6) AS min, round(max(metric), 6) AS max, count(metric) AS count FROM runs GROUP BY seed")
def runs_seed_summary(spark: SparkSession, d: str) -> DataFrame:
    return runs.summary(runs_of(spark, d), "seed", F.expr("try_cast(cast(metric as string) as double)"))


@query(f"WITH {RUNS} SELECT arm, seed, cell, event_id FROM (SELECT *, row_number() OVER (PARTITION BY arm, seed, cell ORDER BY ts DESC, event_id DESC) AS r FROM runs) WHERE r = 1")
def runs_newest_wins(spark: SparkSession, d: str) -> DataFrame:
    return names.newest(runs_of(spark, d), ["arm", "seed", "cell"], ["ts", "event_id"]).select("arm", "seed", "cell", "event_id")


@query(f"WITH {CELLS} SELECT arm, seed, cell, concat_ws(',', CASE WHEN metric > 60 THEN 'high' END, CASE WHEN metric < 35 THEN 'low' END, CASE WHEN seed = 0 THEN 'first' END) AS flags FROM c")
def runs_flags(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("metric")
    return cells_of(spark, d).select("arm", "seed", "cell", runs.flags([("high", m > 60), ("low", m < 35), ("first", F.col("seed") == 0)]).alias("flags"))


@query(f"WITH {RUNS} SELECT seed, " + ", ".join(f"round(avg(metric) FILTER (arm = '{a}'), 6) AS {a}_mean, count(metric) FILTER (arm = '{a}') AS {a}_n" for a in ("click", "error", "purchase", "signup", "view")) + " FROM runs GROUP BY seed")
def runs_pivot_wide(spark: SparkSession, d: str) -> DataFrame:
    arms = ["click", "error", "purchase", "signup", "view"]
    return runs_of(spark, d).groupBy("seed").pivot("arm", arms).agg(F.avg("metric").alias("mean"), F.count("metric").alias("n"))


@query(f"WITH {CELLS}, g AS (SELECT seed, cell FROM (SELECT unnest(range(0, 14)) AS seed) CROSS JOIN (SELECT unnest(range(0, 6)) AS cell)) SELECT g.seed::BIGINT AS seed, g.cell::INT AS cell, round(metric, 6) AS metric FROM g LEFT JOIN (SELECT * FROM c WHERE arm = 'view') v ON g.seed = v.seed AND g.cell = v.cell")
def runs_densified_grid(spark: SparkSession, d: str) -> DataFrame:
    return runs.densify(cells_of(spark, d).filter("arm = 'view'"), {"seed": list(range(14)), "cell": list(range(6))}, "metric")


@query(f"WITH {CELLS}, w AS (SELECT * FROM c UNION ALL SELECT 'view_again', seed, cell, metric FROM c WHERE arm = 'view') SELECT a.arm AS arm_a, b.arm AS arm_b, count(*) AS n, round(max(abs(a.metric - b.metric)), 6) AS gap FROM w a JOIN w b USING (seed, cell) WHERE a.arm < b.arm GROUP BY a.arm, b.arm HAVING count(*) >= 3 AND max(abs(a.metric - b.metric)) < 1e-9")
def runs_duplicate_arms(spark: SparkSession, d: str) -> DataFrame:
    c = cells_of(spark, d)
    again = c.filter("arm = 'view'").withColumn("arm", F.lit("view_again"))
    return runs.duplicate_arms(c.unionByName(again), "arm", ["seed", "cell"], "metric", 1e-9, 3)


@query("""WITH s AS (SELECT user_id, event_id, avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS v FROM events),
e AS (SELECT user_id, arg_max(v, event_id) AS last, count(*) AS n FROM s GROUP BY user_id),
b AS (SELECT s.user_id, max(CASE WHEN abs(v - last) > 0.05 * last THEN event_id END) AS bad FROM s JOIN e USING (user_id) GROUP BY s.user_id)
SELECT s.user_id, min(CASE WHEN n >= 3 AND last > 0 AND (bad IS NULL OR event_id > bad) THEN event_id END) AS settled FROM s JOIN b USING (user_id) JOIN e USING (user_id) GROUP BY s.user_id""")
def curve_settling_point(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    order = W.partitionBy("user_id").orderBy("event_id").rowsBetween(W.unboundedPreceding, 0)
    s = table(spark, d, "events").select("user_id", "event_id", F.avg("value").over(order).alias("v"))
    return runs.settling_point(s, "user_id", "event_id", "v", 0.05)


@query("SELECT DISTINCT event_type, round(value, 6) AS value, round(cume_dist() OVER (PARTITION BY event_type ORDER BY events.value), 6) AS share FROM events")
def ecdf(spark: SparkSession, d: str) -> DataFrame:
    return runs.ecdf(table(spark, d, "events").select("event_type", "value"), "event_type", "value")


@query("SELECT user_id, event_id, round(min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 6) AS best FROM events")
def history_best_so_far(spark: SparkSession, d: str) -> DataFrame:
    return runs.best_so_far(table(spark, d, "events").select("user_id", "event_id", "value"), "user_id", "event_id", "value").select("user_id", "event_id", "best")


@query("WITH u AS (SELECT user_id, sum(value) AS s, count(value) AS c, row_number() OVER (ORDER BY user_id) - 1 AS r FROM events GROUP BY user_id), n AS (SELECT count(*) AS n FROM u), sl AS (SELECT b, s, floor(('0x' || substr(md5('11:' || b || ':' || s), 1, 13))::BIGINT / 4503599627370496.0 * n)::BIGINT AS r FROM n, range(0, 200) AS x(b), range(0, (SELECT n FROM n)) AS y(s)), m AS (SELECT sl.b, sum(u.s) / sum(u.c) AS m FROM sl JOIN u USING (r) GROUP BY sl.b) SELECT count(*) AS draws, round(quantile_cont(m, 0.025), 6) AS lower, round(quantile_cont(m, 0.975), 6) AS upper, round(avg(m), 6) AS mean FROM m")
def boot_unit_ci(spark: SparkSession, d: str) -> DataFrame:
    return runs.bootstrap_mean(table(spark, d, "events"), "user_id", "value", 200, 11)


@query("""WITH g AS (SELECT l_suppkey AS k, l_returnflag AS cell_type, avg(l_discount) AS rate, avg(l_quantity) AS weight, count(*) AS n FROM lineitem GROUP BY ALL),
a AS (SELECT k, median(rate) AS centre, stddev_samp(rate) AS sd, avg(weight) AS weight, count(*) AS types FROM g WHERE n >= 10 GROUP BY k),
s AS (SELECT *, coalesce(sd, 0) / centre AS cv FROM a WHERE centre > 0), t AS (SELECT * FROM s WHERE types < 2 OR cv <= 0.2), l AS (SELECT avg(ln(centre)) AS lm FROM t)
SELECT k, types, round(centre / exp(lm) * 0.5, 6) AS rate, round(weight, 6) AS weight, round(CASE WHEN types >= 2 THEN greatest(cv, 0.05) ELSE 0.05 END, 6) AS sigma FROM t, l""")
def anchor_rate_resolution(spark: SparkSession, d: str) -> DataFrame:
    """AGG51: median rate of each anchor over its measurements, those that vary too much left out; the mean of the
    measurements' weights; the spread relative to the centre, no less than a floor. Rates scaled to a geometric mean of 0.5."""
    g = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("k"), "l_returnflag").agg(F.avg("l_discount").alias("rate"), F.avg("l_quantity").alias("weight"), F.count("*").alias("n"))
    a = g.filter("n >= 10").groupBy("k").agg(F.percentile("rate", 0.5).alias("centre"), F.stddev_samp("rate").alias("sd"), F.avg("weight").alias("weight"), F.count("*").alias("types"))
    s = a.filter("centre > 0").withColumn("cv", F.coalesce("sd", F.lit(0.0)) / F.col("centre")).filter("types < 2 or cv <= 0.2")
    t = s.agg(F.avg(F.log("centre")).alias("lm"))
    sigma = F.when(F.col("types") >= 2, F.greatest("cv", F.lit(0.05))).otherwise(0.05)
    return s.crossJoin(F.broadcast(t)).select("k", "types", (F.col("centre") / F.exp("lm") * 0.5).alias("rate"), "weight", sigma.alias("sigma"))  # t: one row
