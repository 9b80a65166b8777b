"""Summaries, normalisations, resampling intervals and composed reports over the effect, run and count tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import average_rank, pearson, ratio
from ..operators import profiles, resampling
from ..sources.tables import table
from .effects import EFFECTS, PAIRS, cells, effects_of, pairs, r
from .effects import CELLS as UNITS
from .populations import COUNTS, counts
from .registry import query
from .runs import CELLS, cells_of


@query(f"WITH {UNITS}, g AS (SELECT grp, measure, avg(value) AS m, count(*) AS n FROM cells GROUP BY ALL HAVING count(*) >= 10) SELECT a.grp, a.measure, a.n, round(a.m - b.m, 6) + 0.0 AS delta FROM g a JOIN g b ON a.measure = b.measure AND b.grp = '5-LOW' WHERE a.grp <> '5-LOW'")
def agg_group_deltas(spark: SparkSession, d: str) -> DataFrame:
    """AGG1, AGG6, AGG113: mean of each group and measure less the control's; small groups are dropped."""
    g = cells(spark, d).groupBy("grp", "measure").agg(F.avg("value").alias("m"), F.count("*").alias("n")).filter("n >= 10")
    c = g.filter("grp = '5-LOW'").select("measure", F.col("m").alias("m0"))
    return g.filter("grp <> '5-LOW'").join(c, "measure").select("grp", "measure", "n", (F.col("m") - F.col("m0")).alias("delta"))


SCORE = "count(*) AS n, round(corr(predicted, observed), 6) + 0.0 AS pearson, round(avg(abs(predicted - observed)), 6) AS mae, round(sqrt(avg((predicted - observed) ^ 2)), 6) AS rmse"


def score(df: DataFrame, *by: str) -> DataFrame:
    err = F.col("predicted") - F.col("observed")
    return df.groupBy(*by).agg(F.count("*").alias("n"), pearson("predicted", "observed").alias("pearson"), F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"))


@query(f"WITH {PAIRS} SELECT replicate, {SCORE} FROM pp GROUP BY replicate")
def score_per_run(spark: SparkSession, d: str) -> DataFrame:
    """AGG11, AGG29, AGG95: correlation, error and count per run (replicate)."""
    return score(pairs(spark, d), "replicate")


@query(f"WITH {PAIRS}, f AS (SELECT *, abs(observed) >= 0.01 AS big, grp < '3' AS urgent FROM pp), u AS (SELECT 'all' AS subset, predicted, observed FROM f UNION ALL SELECT 'big', predicted, observed FROM f WHERE big UNION ALL SELECT 'urgent', predicted, observed FROM f WHERE urgent UNION ALL SELECT 'both', predicted, observed FROM f WHERE big AND urgent) SELECT subset, {SCORE}, round(sum(predicted * observed) / sqrt(sum(predicted ^ 2) * sum(observed ^ 2)), 6) + 0.0 AS cosine FROM u GROUP BY subset")
def score_subsets(spark: SparkSession, d: str) -> DataFrame:
    """AGG16, AGG28, AGG37: the scores in each of four boolean subsets, a row counting in every one it is in."""
    big, urgent = F.abs("observed") >= 0.01, F.col("grp") < "3"
    names = F.array_compact(F.array(F.lit("all"), F.when(big, "big"), F.when(urgent, "urgent"), F.when(big & urgent, "both")))
    x = pairs(spark, d).withColumn("subset", F.explode(names))
    c = x.groupBy("subset").agg(ratio(F.sum(F.col("predicted") * F.col("observed")), F.sqrt(F.sum(F.col("predicted") ** 2) * F.sum(F.col("observed") ** 2))).alias("cosine"))
    return score(x, "subset").join(c, "subset")


@query(f"WITH {PAIRS}, s AS (SELECT replicate, corr(predicted, observed) AS c FROM pp GROUP BY replicate), m AS (SELECT grp, measure, avg(predicted) AS predicted, avg(observed) AS observed FROM pp GROUP BY ALL) SELECT (SELECT count(*) FROM s) AS seeds, round((SELECT avg(c) FROM s), 6) + 0.0 AS mean_pearson, round((SELECT stddev_samp(c) FROM s), 6) AS sd_pearson, round((SELECT corr(predicted, observed) FROM m), 6) + 0.0 AS consensus_pearson")
def score_seeds_and_consensus(spark: SparkSession, d: str) -> DataFrame:
    """AGG17, AGG121, BS4: mean and deviation over seeds against the score of the seeds' mean prediction."""
    p = pairs(spark, d)
    s = p.groupBy("replicate").agg(pearson("predicted", "observed").alias("c")).agg(F.count("*").alias("seeds"), F.avg("c").alias("mean_pearson"), F.stddev_samp("c").alias("sd_pearson"))
    m = p.groupBy("grp", "measure").agg(F.avg("predicted").alias("predicted"), F.avg("observed").alias("observed")).agg(pearson("predicted", "observed").alias("consensus_pearson"))
    return s.crossJoin(m)  # one row each


@query(f"WITH {CELLS} SELECT arm, cell, round(avg(metric), 4) AS mean, round(coalesce(stddev_samp(metric), 0), 4) AS sd, CASE WHEN count(*) > 1 THEN round(stddev_pop(metric), 6) END AS pop_sd, count(*) AS n, count_if(metric < 40) AS below FROM c GROUP BY arm, cell")
def agg_stage_summary(spark: SparkSession, d: str) -> DataFrame:
    """AGG21, AGG25, AGG26, AGG27, AGG49: means and deviations (0 or null for a single value) and conditional counts."""
    m = F.col("metric")
    return cells_of(spark, d).groupBy("arm", "cell").agg(F.round(F.avg(m), 4).alias("mean"), F.round(F.coalesce(F.stddev_samp(m), F.lit(0.0)), 4).alias("sd"), F.when(F.count("*") > 1, F.stddev_pop(m)).alias("pop_sd"), F.count("*").alias("n"), F.count_if(m < 40).alias("below"))


@query(f"WITH {CELLS} SELECT arm, round(median(metric), 6) AS median, round(min(metric), 6) AS least, round(max(metric), 6) AS most, count(metric) AS n, (SELECT max(k) FROM (SELECT count(*) AS k FROM c x WHERE x.arm = c.arm GROUP BY seed)) AS largest FROM c GROUP BY arm")
def agg_median_range(spark: SparkSession, d: str) -> DataFrame:
    """AGG30, AGG31, AGG48: median, extremes and count per key, and the size of its largest group."""
    c = cells_of(spark, d)
    q = profiles.exact_quantiles(c, ["arm"], "metric", (0.5,)).select("arm", F.col("quantile").alias("median"))
    m = c.groupBy("arm").agg(F.min("metric").alias("least"), F.max("metric").alias("most"), F.count("metric").alias("n"))
    big = c.groupBy("arm", "seed").count().groupBy("arm").agg(F.max("count").alias("largest"))
    return m.join(q, "arm").join(big, "arm")


@query(f"WITH {CELLS}, p AS (SELECT seed, cell, avg(metric) FILTER (arm = 'click') AS a, avg(metric) FILTER (arm = 'view') AS b FROM c GROUP BY ALL) SELECT cell, count(*) AS n, round(avg(a - b), 6) + 0.0 AS delta, round(100 * avg(a) / avg(b) - 100, 6) + 0.0 AS percent FROM p WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY cell")
def agg_paired_pivot(spark: SparkSession, d: str) -> DataFrame:
    """AGG32, AGG33, AGG120: two arms as columns, complete pairs, their mean difference and percentage."""
    p = cells_of(spark, d).groupBy("seed", "cell").pivot("arm", ["click", "view"]).agg(F.avg("metric")).filter("click is not null and view is not null")
    return p.groupBy("cell").agg(F.count("*").alias("n"), F.avg(F.col("click") - F.col("view")).alias("delta"), (100 * F.avg("click") / F.avg("view") - 100).alias("percent"))


@query(f"WITH {CELLS}, k AS (SELECT cell FROM c GROUP BY cell HAVING count(DISTINCT arm) = (SELECT count(DISTINCT arm) FROM c)) SELECT arm, count(*) AS n, round(avg(metric), 6) AS mean FROM c WHERE cell IN (SELECT cell FROM k) GROUP BY arm")
def agg_fixed_panel(spark: SparkSession, d: str) -> DataFrame:
    """AGG34: means over the members that every arm has."""
    c = cells_of(spark, d)
    arms = c.agg(F.countDistinct("arm").alias("arms"))
    k = c.groupBy("cell").agg(F.countDistinct("arm").alias("n")).crossJoin(F.broadcast(arms)).filter("n = arms").select("cell")  # arms: one row
    return c.join(k, "cell", "left_semi").groupBy("arm").agg(F.count("*").alias("n"), F.avg("metric").alias("mean"))


@query(f"WITH {EFFECTS}, m AS (SELECT grp, measure, avg(delta) AS v FROM eff GROUP BY ALL), s AS (SELECT measure, stddev_pop(v) AS s FROM m GROUP BY measure), c AS (SELECT a.grp AS a, b.grp AS b, corr(a.v, b.v) AS c FROM m a JOIN m b USING (measure) WHERE a.grp < b.grp GROUP BY ALL) SELECT round((SELECT avg(s) FROM s), 6) AS spread, round((SELECT avg(c) FROM c), 6) + 0.0 AS mean_correlation")
def agg_profile_spread(spark: SparkSession, d: str) -> DataFrame:
    """AGG36, AGG122: spread of the groups' profiles and the mean correlation of every two."""
    m = effects_of(spark, d).groupBy("grp", "measure").agg(F.avg("delta").alias("v"))
    s = m.groupBy("measure").agg(F.stddev_pop("v").alias("s")).agg(F.avg("s").alias("spread"))
    two = m.select("measure", F.col("grp").alias("a"), F.col("v").alias("x")).join(m.select("measure", F.col("grp").alias("b"), F.col("v").alias("y")), "measure").filter("a < b")
    return s.crossJoin(two.groupBy("a", "b").agg(pearson("x", "y").alias("c")).agg(F.avg("c").alias("mean_correlation")))  # one row each


@query("WITH c AS (SELECT label % 3 AS t, (CASE WHEN embedding[1] > 0 THEN 1 ELSE 0 END + CASE WHEN embedding[2] > 0 THEN 1 ELSE 0 END) AS g, count(*) AS n FROM embeddings GROUP BY ALL), p(a, b, c) AS (VALUES (0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0)), s AS (SELECT a, b, c, (SELECT sum(n) FROM c x WHERE (t = 0 AND g = p.a) OR (t = 1 AND g = p.b) OR (t = 2 AND g = p.c)) AS hit FROM p) SELECT round(max(hit) FILTER (a = 0 AND b = 1) / (SELECT sum(n) FROM c), 6) AS accuracy, round(max(hit) / (SELECT sum(n) FROM c), 6) AS best FROM s")
def agg_branch_scores(spark: SparkSession, d: str) -> DataFrame:
    """AGG41, AGG43: accuracy of three labels, and the best over all renamings of the guesses."""
    from itertools import permutations

    e = table(spark, d, "embeddings").select((F.col("label") % 3).alias("t"), ((F.col("embedding")[0] > 0).cast("int") + (F.col("embedding")[1] > 0).cast("int")).alias("g"))
    n = e.groupBy("t", "g").agg(F.count("*").alias("n"))
    hits = [F.sum(F.when(F.get(F.array(*map(F.lit, p)), F.col("t")) == F.col("g"), F.col("n")).otherwise(0)) for p in permutations(range(3))]
    return n.agg((hits[0] / F.sum("n")).alias("accuracy"), (F.greatest(*hits) / F.sum("n")).alias("best"))


@query("SELECT event_type, round(avg((abs(value - 50) < 1)::INT), 6) AS at_middle, round(avg((value < 1)::INT), 6) AS at_least, round(avg((value > 99)::INT), 6) AS at_most, round(avg(CASE WHEN value > 0 THEN value END), 6) AS mean_positive FROM events GROUP BY event_type")
def agg_saturation(spark: SparkSession, d: str) -> DataFrame:
    """AGG44, AGG47, AGG52: shares near the middle and the bounds, and the mean of what is positive."""
    v = F.col("value")
    share = lambda c: F.avg(c.cast("int"))
    return table(spark, d, "events").groupBy("event_type").agg(share(F.abs(v - 50) < 1).alias("at_middle"), share(v < 1).alias("at_least"), share(v > 99).alias("at_most"), F.avg(F.when(v > 0, v)).alias("mean_positive"))


@query("SELECT c_nationkey, count(*) AS n, count_if(c_acctbal > 0) AS positive, count_if(c_mktsegment = 'BUILDING') AS building, count_if(c_acctbal > 0 AND c_mktsegment = 'BUILDING') AS both, count(DISTINCT c_mktsegment) AS segments FROM customer GROUP BY c_nationkey")
def agg_conditional_counts(spark: SparkSession, d: str) -> DataFrame:
    """AGG53, AGG56, AGG60: conditional counts beside the identity of each data set."""
    a, b = F.col("c_acctbal") > 0, F.col("c_mktsegment") == "BUILDING"
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.count_if(a).alias("positive"), F.count_if(b).alias("building"), F.count_if(a & b).alias("both"), F.countDistinct("c_mktsegment").alias("segments"))


@query(f"WITH {COUNTS} SELECT c, bool_or(s > 0) AS in_s, bool_or(u > 0) AS in_u, c < 25 AS in_panel, concat_ws(',', CASE WHEN bool_or(s > 0) THEN 's' END, CASE WHEN bool_or(u > 0) THEN 'u' END, CASE WHEN c < 25 THEN 'panel' END) AS stages FROM x GROUP BY c")
def agg_membership(spark: SparkSession, d: str) -> DataFrame:
    """AGG58, AGG59: in which of several stage sets each feature is."""
    s, u, p = F.bool_or(F.col("s") > 0), F.bool_or(F.col("u") > 0), F.col("c") < 25
    return counts(spark, d).groupBy("c").agg(s.alias("in_s"), u.alias("in_u"), F.first(p).alias("in_panel"), F.concat_ws(",", F.when(s, "s"), F.when(u, "u"), F.when(F.first(p), "panel")).alias("stages"))


ROWS = COUNTS + ", t AS (SELECT r, sum(s) AS ts, sum(u) AS tu FROM x GROUP BY r), md AS (SELECT median(ts) AS m FROM t WHERE ts > 0)"


def totals(spark: SparkSession, d: str) -> DataFrame:
    return counts(spark, d).groupBy("r").agg(F.sum("s").alias("ts"), F.sum("u").alias("tu"))


def median_total(spark: SparkSession, d: str) -> DataFrame:
    return profiles.exact_quantiles(totals(spark, d).filter("ts > 0"), [], "ts", (0.5,)).select(F.col("quantile").alias("m"))


@query(f"WITH {ROWS} SELECT x.r, c, round(CASE WHEN ts > 0 THEN s / ts * 10000 ELSE 0 END, 6) AS linear, round(CASE WHEN ts > 0 THEN ln(1 + s / ts * 10000) ELSE 0 END, 6) AS logged FROM x JOIN t USING (r)")
def norm_library(spark: SparkSession, d: str) -> DataFrame:
    """AGG67, AGG68, AGG69: ten thousand per row, linear and logged; empty rows stay empty."""
    t = F.sum("s").over(W.partitionBy("r"))
    v = F.when(t > 0, F.col("s") / F.when(t > 0, t) * 10000).otherwise(0.0)
    return counts(spark, d).select("r", "c", v.alias("linear"), F.log1p(v).alias("logged"))


@query(f"WITH {ROWS} SELECT r, round(CASE WHEN tu > 0 AND ts > 0 THEN ts / tu ELSE 1 END, 6) AS layer_ratio, round(ts / m, 6) AS size_factor FROM t, md")
def norm_row_ratios(spark: SparkSession, d: str) -> DataFrame:
    """AGG70, AGG72, AGG73, AGG76: ratio of a row's totals in two layers (1 where one is empty), and its total over the median positive one."""
    m = median_total(spark, d)
    ratio_ = F.when((F.col("tu") > 0) & (F.col("ts") > 0), F.col("ts") / F.when(F.col("tu") > 0, F.col("tu"))).otherwise(1.0)
    return totals(spark, d).crossJoin(F.broadcast(m)).select("r", ratio_.alias("layer_ratio"), (F.col("ts") / F.col("m")).alias("size_factor"))  # m: one row


@query(f"WITH {ROWS} SELECT x.r, c, round(ln(1 + s * CASE WHEN ts + tu > 0 THEN m / (ts + tu) ELSE 0 END), 6) AS s, round(ln(1 + u * CASE WHEN ts + tu > 0 THEN m / (ts + tu) ELSE 0 END), 6) AS u, round(s / m, 6) AS s_linear FROM x JOIN t USING (r), md")
def norm_shared_factor(spark: SparkSession, d: str) -> DataFrame:
    """AGG74, AGG75, AGG78: both layers logged under one factor of the row, and under one scale of the table."""
    x = counts(spark, d).join(totals(spark, d), "r").crossJoin(F.broadcast(median_total(spark, d)))  # one row
    whole = F.col("ts") + F.col("tu")
    f = F.when(whole > 0, F.col("m") / F.when(whole > 0, whole)).otherwise(0.0)
    return x.select("r", "c", F.log1p(F.col("s") * f).alias("s"), F.log1p(F.col("u") * f).alias("u"), (F.col("s") / F.col("m")).alias("s_linear"))


@query(f"WITH {ROWS}, df AS (SELECT c, count_if(s > 0) AS df FROM x GROUP BY c), n AS (SELECT count(*) AS n FROM t) SELECT x.r, c, round(CASE WHEN ts > 0 THEN s / ts ELSE 0 END * ln(1 + n / (df + 1)), 6) AS tfidf FROM x JOIN t USING (r) JOIN df USING (c), n")
def norm_tfidf(spark: SparkSession, d: str) -> DataFrame:
    """AGG65: (value / row sum) * log(1 + rows / (rows with the feature + 1))."""
    x = counts(spark, d)
    n = x.select("r").distinct().agg(F.count("*").alias("n"))
    df = x.groupBy("c").agg(F.count_if(F.col("s") > 0).alias("df"))
    t = x.groupBy("r").agg(F.sum("s").alias("ts"))
    y = x.join(t, "r").join(df, "c").crossJoin(F.broadcast(n))  # n: one row
    return y.select("r", "c", (F.when(F.col("ts") > 0, F.col("s") / F.when(F.col("ts") > 0, F.col("ts"))).otherwise(0.0) * F.log1p(F.col("n") / (F.col("df") + 1))).alias("tfidf"))


@query(f"WITH {COUNTS}, m AS (SELECT c, avg(s) AS ms, stddev_pop(s) AS ss, stddev_pop(u) AS su FROM x GROUP BY c) SELECT r, c, round(CASE WHEN ss > 1e-12 THEN (s - ms) / ss ELSE 0 END, 6) + 0.0 AS z, round(CASE WHEN ss > 1e-12 THEN su / ss ELSE 0 END, 6) AS scale FROM x JOIN m USING (c)")
def norm_columns(spark: SparkSession, d: str) -> DataFrame:
    """AGG80, AGG85: standardised columns (constant ones 0), and the second layer's deviation over the first's."""
    x = counts(spark, d)
    m = x.groupBy("c").agg(F.avg("s").alias("ms"), F.stddev_pop("s").alias("ss"), F.stddev_pop("u").alias("su"))
    safe = F.when(F.col("ss") > 1e-12, F.col("ss"))
    return x.join(m, "c").select("r", "c", F.coalesce((F.col("s") - F.col("ms")) / safe, F.lit(0.0)).alias("z"), F.coalesce(F.col("su") / safe, F.lit(0.0)).alias("scale"))


@query(f"WITH {PAIRS}, f AS (SELECT measure, regr_slope(observed, predicted) AS a, regr_intercept(observed, predicted) AS b FROM pp WHERE grp < '3' GROUP BY measure) SELECT grp, measure, replicate, round(greatest(a * predicted + b, -0.05), 6) + 0.0 AS calibrated, a * predicted + b < -0.05 AS clipped FROM pp JOIN f USING (measure)")
def calibrated_on_controls(spark: SparkSession, d: str) -> DataFrame:
    """AGG84, AGG86, AGG124, AGG125: a line per measure fitted on the control groups, applied to all, clipped below with a mark."""
    p = pairs(spark, d)
    f = p.filter("grp < '3'").groupBy("measure").agg(F.regr_slope("observed", "predicted").alias("a"), F.regr_intercept("observed", "predicted").alias("b"))
    y = F.col("a") * F.col("predicted") + F.col("b")
    return p.join(f, "measure").select("grp", "measure", "replicate", F.greatest(y, F.lit(-0.05)).alias("calibrated"), (y < -0.05).alias("clipped"))


@query(f"WITH {UNITS}, m AS (SELECT grp, measure, avg(value - cognate) AS shift, count(*) AS n FROM cells GROUP BY ALL) SELECT grp, round(sum(shift * n) / sum(n), 6) AS mean_shift, round(max(shift) - min(shift), 6) AS span FROM m GROUP BY grp")
def agg_shift(spark: SparkSession, d: str) -> DataFrame:
    """AGG112, AGG123: mean difference of paired matrices per group, weighted by rows."""
    m = cells(spark, d).groupBy("grp", "measure").agg(F.avg(F.col("value") - F.col("cognate")).alias("shift"), F.count("*").alias("n"))
    return m.groupBy("grp").agg((F.sum(F.col("shift") * F.col("n")) / F.sum("n")).alias("mean_shift"), (F.max("shift") - F.min("shift")).alias("span"))


@query("""WITH e AS (SELECT user_id, event_id, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS back, value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS step FROM events),
s AS (SELECT user_id, min(v) AS lo, max(v) AS hi, avg(CASE WHEN back <= 5 THEN v END) AS tail_mean, stddev_pop(CASE WHEN back <= 5 THEN v END) AS tail_sd, avg((abs(step) < 1)::INT) AS flat FROM e GROUP BY user_id)
SELECT user_id, round(tail_mean, 6) AS tail_mean, round(CASE WHEN tail_mean <> 0 THEN tail_sd / abs(tail_mean) END, 6) AS tail_cv, round(hi - lo, 6) AS span, round(flat, 6) AS flat_share FROM s""")
def curve_signature(spark: SparkSession, d: str) -> DataFrame:
    """AGG117: mean and variation of a curve's tail, its range, and the share of flat steps."""
    e = table(spark, d, "events").select("user_id", "event_id", F.col("value").alias("v"))
    w = W.partitionBy("user_id")
    e = e.withColumn("back", F.row_number().over(w.orderBy(F.desc("event_id")))).withColumn("step", F.col("v") - F.lag("v").over(w.orderBy("event_id")))
    tail = F.when(F.col("back") <= 5, F.col("v"))
    s = e.groupBy("user_id").agg((F.max("v") - F.min("v")).alias("span"), F.avg(tail).alias("tail_mean"), F.stddev_pop(tail).alias("sd"), F.avg((F.abs("step") < 1).cast("int")).alias("flat_share"))
    return s.select("user_id", "tail_mean", ratio(F.col("sd"), F.abs("tail_mean")).alias("tail_cv"), "span", "flat_share")


#: Draw b, slot s takes the unit at floor(hash * n) of the ordered units, as in ``boot_unit_ci``.
DRAWS = """u AS (SELECT *, row_number() OVER (ORDER BY unit) - 1 AS k FROM (SELECT DISTINCT grp || ':' || measure AS unit FROM pp)), nn AS (SELECT count(*) AS n FROM u),
sl AS (SELECT b, floor(('0x' || substr(md5('{0}:' || b || ':' || s), 1, 13))::BIGINT / 4503599627370496.0 * n)::BIGINT AS k FROM nn, range(0, 60) AS x(b), range(0, (SELECT n FROM nn)) AS y(s)), dr AS (SELECT b, unit FROM sl JOIN u USING (k))"""


@query(f"""WITH {PAIRS}, {DRAWS.format(21)}, q AS (SELECT grp || ':' || measure AS unit, predicted AS x, observed * 0.5 + predicted * 0.1 AS z, observed AS y FROM pp), e AS (SELECT b, x, z, y FROM dr JOIN q USING (unit)),
k AS (SELECT b, """ + ", ".join(f"rank() OVER (PARTITION BY b ORDER BY {c}) + (count(*) OVER (PARTITION BY b, {c}) - 1) / 2.0 AS r{c}" for c in "xyz") + """ FROM e),
g AS (SELECT b, corr(rx, ry) - corr(rz, ry) AS gap FROM k GROUP BY b) SELECT count(gap) AS draws, round(avg(gap), 6) + 0.0 AS mean, round(quantile_cont(gap, 0.025), 6) + 0.0 AS lower, round(quantile_cont(gap, 0.975), 6) + 0.0 AS upper FROM g WHERE gap IS NOT NULL AND NOT isnan(gap)""")
def boot_spearman_gap(spark: SparkSession, d: str) -> DataFrame:
    """BS1: paired bootstrap, by unit, of the difference of two rank correlations; degenerate draws are left out."""
    p = pairs(spark, d).select(F.concat_ws(":", "grp", "measure").alias("unit"), F.col("predicted").alias("x"), (F.col("observed") * 0.5 + F.col("predicted") * 0.1).alias("z"), F.col("observed").alias("y"))
    e = resampling.drawn(p, "unit", 60, 21)
    k = e.withColumns({f"r{c}": average_rank(c, "b") for c in "xyz"})
    g = k.groupBy("b").agg((pearson("rx", "ry") - pearson("rz", "ry")).alias("gap"))
    return resampling.interval(g, "gap")


@query(f"""WITH {PAIRS}, {DRAWS.format(22)}, q AS (SELECT grp || ':' || measure AS unit, predicted AS x, observed * 0.5 + predicted * 0.1 AS z, observed AS y FROM pp), e AS (SELECT b, x, z, y FROM dr JOIN q USING (unit)),
g AS (SELECT b, corr(x, y) - corr(z, y) AS gap FROM e GROUP BY b) SELECT count(gap) AS draws, round(avg(gap), 6) + 0.0 AS mean, round(quantile_cont(gap, 0.025), 6) + 0.0 AS lower, round(quantile_cont(gap, 0.975), 6) + 0.0 AS upper FROM g WHERE gap IS NOT NULL AND NOT isnan(gap)""")
def boot_correlation_difference(spark: SparkSession, d: str) -> DataFrame:
    """BS3, AGG18: one draw of units shared by both arms, difference of their correlations."""
    p = pairs(spark, d).select(F.concat_ws(":", "grp", "measure").alias("unit"), F.col("predicted").alias("x"), (F.col("observed") * 0.5 + F.col("predicted") * 0.1).alias("z"), F.col("observed").alias("y"))
    g = resampling.drawn(p, "unit", 60, 22).groupBy("b").agg((pearson("x", "y") - pearson("z", "y")).alias("gap"))
    return resampling.interval(g, "gap")


@query(f"""WITH {PAIRS}, {DRAWS.format(23)}, q AS (SELECT grp || ':' || measure AS unit, avg(observed) AS v FROM pp GROUP BY ALL), g AS (SELECT b, avg(v) AS m FROM dr JOIN q USING (unit) GROUP BY b)
SELECT count(*) AS draws, round(avg(m), 6) + 0.0 AS mean, round(quantile_cont(m, 0.025), 6) + 0.0 AS lower, round(quantile_cont(m, 0.975), 6) + 0.0 AS upper FROM g""")
def boot_mean_interval(spark: SparkSession, d: str) -> DataFrame:
    """BS5, AGG35: percentile interval of the mean of one value per unit."""
    q = pairs(spark, d).groupBy(F.concat_ws(":", "grp", "measure").alias("unit")).agg(F.avg("observed").alias("v"))
    return resampling.interval(resampling.drawn(q, "unit", 60, 23).groupBy("b").agg(F.avg("v").alias("m")), "m")


@query(f"""WITH {UNITS}, k AS (SELECT DISTINCT grp FROM cells), n AS (SELECT count(*) AS n FROM k), o AS (SELECT grp, row_number() OVER (ORDER BY grp) - 1 AS i FROM k), m AS (SELECT grp, measure, avg(value) AS v FROM cells GROUP BY ALL),
s AS (SELECT b, a.grp AS had, c.grp AS got FROM o a, n, range(1, 5) AS g(b), o c WHERE c.i = (a.i + b) % n), x AS (SELECT b, s.had AS grp, m.measure, m.v FROM s JOIN m ON m.grp = s.got), e AS (SELECT x.b, x.grp, x.measure, x.v - c.v AS delta FROM x JOIN x c ON x.b = c.b AND x.measure = c.measure AND c.grp = '5-LOW' WHERE x.grp <> '5-LOW'),
t AS (SELECT a.grp, a.measure, a.v - c.v AS truth FROM m a JOIN m c ON a.measure = c.measure AND c.grp = '5-LOW' WHERE a.grp <> '5-LOW') SELECT b AS shift, round(corr(delta, truth), 6) + 0.0 AS pearson FROM e JOIN t USING (grp, measure) GROUP BY b""")
def boot_shuffled_null(spark: SparkSession, d: str) -> DataFrame:
    """BS6: the contrast recomputed after moving the groups' labels round, scored against the true contrast."""
    m = cells(spark, d).groupBy("grp", "measure").agg(F.avg("value").alias("v"))
    k = m.select("grp").distinct()
    o = k.withColumn("i", F.row_number().over(W.orderBy("grp")) - 1).crossJoin(k.agg(F.count("*").alias("n")))  # one row per group
    s = o.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(4)))).select(F.col("grp").alias("had"), "b", ((F.col("i") + F.col("b")) % F.col("n")).alias("i")).join(o.select("i", F.col("grp").alias("got")), "i")
    x = s.join(m.withColumnRenamed("grp", "got"), "got").select(F.col("b").cast("long").alias("shift"), F.col("had").alias("grp"), "measure", "v")

    def contrast(df: DataFrame, keys: list[str], name: str) -> DataFrame:
        c = df.filter("grp = '5-LOW'").select(*keys, F.col("v").alias("v0"))
        return df.filter("grp <> '5-LOW'").join(c, keys).select(*keys, "grp", (F.col("v") - F.col("v0")).alias(name))

    e = contrast(x, ["shift", "measure"], "delta").join(contrast(m, ["measure"], "truth"), ["grp", "measure"])
    return e.groupBy("shift").agg(pearson("delta", "truth").alias("pearson"))
