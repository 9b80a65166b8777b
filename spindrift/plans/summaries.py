"""Distribution, coupling, confusion, rank-test and permutation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import profiles
from ..sources.tables import table
from .effects import CELLS, CONTROL, EFFECTS, PAIRS, cells, effects_of, pairs
from .registry import query


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, round(min(value), 6) AS least, round(max(value), 6) AS most, " + ", ".join(f"round(quantile_cont(value, {q}), 6) AS q{round(100 * q):02d}" for q in (0.05, 0.25, 0.5, 0.75, 0.95)) + " FROM events GROUP BY event_type")
def agg_quantile_summary(spark: SparkSession, d: str) -> DataFrame:
    return profiles.quantiles(table(spark, d, "events"), "event_type", value="value")


@query("SELECT l_suppkey, round(coalesce(exp(avg(ln(CASE WHEN l_tax > 0 THEN l_tax END))), 0), 6) AS geometric_mean FROM lineitem GROUP BY l_suppkey")
def agg_geometric_mean(spark: SparkSession, d: str) -> DataFrame:
    return profiles.geometric_mean(table(spark, d, "lineitem"), "l_suppkey", value="l_tax")


@query("WITH p AS (SELECT l_suppkey, l_returnflag || l_linestatus AS t, sum(l_quantity) AS m FROM lineitem GROUP BY ALL), s AS (SELECT l_suppkey, sum(m) AS mass, count(*) AS support, ln(sum(m)) - sum(m * ln(m)) / sum(m) AS h FROM p WHERE m > 0 GROUP BY l_suppkey) SELECT l_suppkey, round(mass, 6) AS mass, support, round(h, 6) AS entropy, round(exp(h), 6) AS effective_support FROM s")
def agg_coupling_profile(spark: SparkSession, d: str) -> DataFrame:
    plan = table(spark, d, "lineitem").groupBy("l_suppkey", F.concat("l_returnflag", "l_linestatus").alias("t")).agg(F.sum("l_quantity").alias("m"))
    return profiles.coupling_profile(plan, "l_suppkey", "m")


@query("WITH c AS (SELECT label, CASE WHEN embedding[1] > 0 THEN 1 ELSE 0 END AS guess, count(*) AS n FROM embeddings GROUP BY ALL) SELECT *, round(n / sum(n) OVER (PARTITION BY label), 6) AS share FROM c")
def agg_confusion(spark: SparkSession, d: str) -> DataFrame:
    return profiles.confusion(table(spark, d, "embeddings").select("label", (F.col("embedding")[0] > 0).cast("int").alias("guess")), "label", "guess")


@query("WITH n AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL) SELECT c_nationkey, arg_min(c_mktsegment, (-n, c_mktsegment)) AS c_mktsegment, round(max(n) / sum(n), 6) AS share FROM n GROUP BY c_nationkey")
def agg_majority_share(spark: SparkSession, d: str) -> DataFrame:
    return profiles.majority_share(table(spark, d, "customer"), "c_nationkey", "c_mktsegment")


@query(f"""WITH {CELLS}, b AS (SELECT grp, measure, value, 1 AS own FROM cells WHERE grp <> '5-LOW' UNION ALL SELECT g.grp, g.measure, c.value, 0 FROM (SELECT DISTINCT grp, measure FROM cells WHERE grp <> '5-LOW') g JOIN cells c ON c.measure = g.measure AND c.grp = '5-LOW'),
r AS (SELECT *, rank() OVER (PARTITION BY grp, measure ORDER BY value) + (count(*) OVER (PARTITION BY grp, measure, value) - 1) / 2.0 AS rk FROM b),
t AS (SELECT grp, measure, sum(n * n * n - n)::DOUBLE AS ties FROM (SELECT grp, measure, value, count(*)::DOUBLE AS n FROM b GROUP BY ALL) GROUP BY grp, measure),
s AS (SELECT grp, measure, sum(own)::DOUBLE AS n1, count_if(own = 0)::DOUBLE AS n2, sum(own * rk) AS r1 FROM r GROUP BY grp, measure),
u AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u, sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS sd FROM s JOIN t USING (grp, measure))
SELECT grp, measure, round(u, 6) AS u, round((abs(u - n1 * n2 / 2) - 0.5) / sd, 6) + 0.0 AS z FROM u""")
def effects_rank_sum(spark: SparkSession, d: str) -> DataFrame:
    return profiles.rank_sum(cells(spark, d), CONTROL).select("grp", "measure", "u", "z")


@query(f"WITH {EFFECTS}, j AS (SELECT a.replicate AS a, b.replicate AS b, a.delta AS x, b.delta AS y FROM eff a JOIN eff b USING (grp, measure) WHERE a.replicate < b.replicate), r AS (SELECT *, rank() OVER (PARTITION BY a, b ORDER BY x) + (count(*) OVER (PARTITION BY a, b, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY a, b ORDER BY y) + (count(*) OVER (PARTITION BY a, b, y) - 1) / 2.0 AS ry FROM j) SELECT a, b, count(*) AS n, round(covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)), 6) + 0.0 AS spearman FROM r GROUP BY a, b HAVING count(*) >= 3")
def effects_replicate_agreement(spark: SparkSession, d: str) -> DataFrame:
    return profiles.replicate_agreement(effects_of(spark, d))


@query(f"WITH {PAIRS}, k AS (SELECT grp || ':' || measure || ':' || replicate AS id, predicted AS x, observed AS y FROM pp), e AS (SELECT b, id, x, y FROM k, range(1, 51) AS g(b)), l AS (SELECT b, x, row_number() OVER (PARTITION BY b ORDER BY id) AS r FROM e), m AS (SELECT b, y, row_number() OVER (PARTITION BY b ORDER BY md5('9:' || b || ':' || id), id) AS r FROM e), c AS (SELECT b, covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) AS c FROM l JOIN m USING (b, r) GROUP BY b) SELECT round((SELECT covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) FROM k), 6) AS observed, round(avg(c), 6) + 0.0 AS null_mean, round(stddev_samp(c), 6) AS null_sd FROM c")
def boot_permutation_null(spark: SparkSession, d: str) -> DataFrame:
    p = pairs(spark, d).withColumn("id", F.concat_ws(":", "grp", "measure", "replicate"))
    return profiles.permutation_null(p, "id", "predicted", "observed", 50, 9)


@query("WITH q AS (SELECT l_returnflag, l_linenumber % 2 AS side, quantile_cont(l_extendedprice, " + str([(i + 0.5) / 100 for i in range(100)]) + ") AS q FROM lineitem GROUP BY ALL) SELECT a.l_returnflag, round(list_avg(list_transform(range(1, 101), lambda i: abs(a.q[i] - b.q[i]))), 4) AS distance FROM q a JOIN q b USING (l_returnflag) WHERE a.side = 0 AND b.side = 1")
def agg_wasserstein(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").select("l_returnflag", (F.col("l_linenumber") % 2).alias("side"), "l_extendedprice")
    return profiles.wasserstein(x, "l_returnflag", "side", "l_extendedprice").select("l_returnflag", F.round("distance", 4).alias("distance"))


@query("SELECT o_orderpriority, count(*) AS n, count(c_custkey) AS matched, round(count(c_custkey) / count(*), 6) AS share FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING') ON o_custkey = c_custkey GROUP BY o_orderpriority")
def agg_match_rate(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "customer").filter("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("id"))
    return profiles.match_rate(table(spark, d, "orders").select("o_orderpriority", F.col("o_custkey").alias("id")), known, "o_orderpriority")


@query(f"WITH {CELLS}, o AS (SELECT grp, measure, replicate, avg(value) AS m FROM cells GROUP BY ALL) SELECT grp, measure, count(*) AS n, round(avg(m), 6) AS mean FROM o GROUP BY grp, measure")
def agg_two_level_mean(spark: SparkSession, d: str) -> DataFrame:
    return profiles.two_level_mean(cells(spark, d), ["grp", "measure"], "replicate", "value")
