"""Joins of keyed tables: alignment by identifiers, validated pairings, lookups with fallbacks, ranked picks.

Bindings: run table = events (arm = event type, seed = user modulo 12, cell), truth and predictions = effect tables,
dictionaries = nation, part and supplier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import sets
from ..sources.tables import table
from .effects import EFFECTS, effects_of, r
from .registry import query
from .runs import CELLS, cells_of


def orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders")


@query("SELECT c_custkey AS id, c_nationkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) AND c_custkey IN (SELECT user_id FROM events)")
def join_common_ids(spark: SparkSession, d: str) -> DataFrame:
    """J1, J2, SET4: rows of the first table whose id all three tables have."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey")
    for other in (orders(spark, d).select(F.col("o_custkey").alias("id")), table(spark, d, "events").select(F.col("user_id").alias("id"))):
        c = c.join(other, "id", "left_semi")
    return c


@query(f"WITH {CELLS} SELECT a.arm, a.seed, a.cell, round(b.metric, 6) AS reference, round(a.metric - b.metric, 6) + 0.0 AS delta FROM c a LEFT JOIN (SELECT * FROM c WHERE arm = 'view') b USING (seed, cell) WHERE a.arm <> 'view'")
def join_paired_effects(spark: SparkSession, d: str) -> DataFrame:
    """Every arm against the reference arm of its (seed, cell), many to one; a missing reference gives null."""
    c = cells_of(spark, d)
    ref = c.filter("arm = 'view'").select("seed", "cell", F.col("metric").alias("reference"))
    return c.filter("arm <> 'view'").join(ref, ["seed", "cell"], "left").select("arm", "seed", "cell", "reference", (F.col("metric") - F.col("reference")).alias("delta"))


@query(f"WITH {CELLS} SELECT a.arm, a.seed, a.cell, round(a.metric - b.metric, 6) + 0.0 AS over_baseline FROM c a LEFT JOIN c b ON a.arm = b.arm AND a.seed = b.seed AND b.cell = 0")
def join_baseline_within(spark: SparkSession, d: str) -> DataFrame:
    """Left self-join to the baseline cell of the same arm and seed."""
    c = cells_of(spark, d)
    base = c.filter("cell = 0").select("arm", "seed", F.col("metric").alias("base"))
    return c.join(base, ["arm", "seed"], "left").select("arm", "seed", "cell", (F.col("metric") - F.col("base")).alias("over_baseline"))


@query(f"WITH {CELLS}, v AS (SELECT seed, cell FROM c WHERE arm = 'view'), k AS (SELECT DISTINCT arm FROM c) SELECT arm, count_if(g IS NULL) AS missing, count_if(w IS NULL) AS extra FROM (SELECT k.arm, seed, cell, 1 AS w FROM k, v) FULL JOIN (SELECT arm, seed, cell, 1 AS g FROM c) USING (arm, seed, cell) GROUP BY arm")
def join_population_check(spark: SparkSession, d: str) -> DataFrame:
    """J6, J7, SET7: per arm, keys of the reference that it lacks and keys that only it has."""
    c = cells_of(spark, d).select("arm", "seed", "cell")
    arms = c.select("arm").distinct()
    wanted = arms.crossJoin(c.filter("arm = 'view'").select("seed", "cell"))  # arms times the reference: what is asked
    both = wanted.withColumn("w", F.lit(1)).join(c.withColumn("g", F.lit(1)), ["arm", "seed", "cell"], "full")
    return both.groupBy("arm").agg(F.count_if(F.col("g").isNull()).alias("missing"), F.count_if(F.col("w").isNull()).alias("extra"))


TRUTH = EFFECTS + ", tr AS (SELECT grp, measure, replicate, delta AS observed FROM eff), pd AS (SELECT grp, measure, avg(delta) AS pooled, max(delta) AS highest, count(*) AS n FROM eff GROUP BY ALL HAVING count(*) >= 2 AND avg(delta) > -1)"


def truth(spark: SparkSession, d: str) -> DataFrame:
    return effects_of(spark, d).select("grp", "measure", "replicate", F.col("delta").alias("observed"))


def predicted(spark: SparkSession, d: str) -> DataFrame:
    e = effects_of(spark, d).groupBy("grp", "measure").agg(F.avg("delta").alias("pooled"), F.max("delta").alias("highest"), F.count("*").alias("n"))
    return e.filter("n >= 2 and pooled > -1")


@query(f"WITH {TRUTH}, u AS (SELECT grp, measure, 'pooled' AS model, pooled AS predicted FROM pd UNION ALL SELECT grp, measure, 'highest', highest FROM pd) SELECT grp, measure, replicate, model, {r('observed', 'predicted')} FROM tr JOIN u USING (grp, measure)")
def join_observed_predictions(spark: SparkSession, d: str) -> DataFrame:
    """The union of all models' predictions, one per pair, joined to every replicate's observation."""
    p = predicted(spark, d)
    u = p.select("grp", "measure", F.lit("pooled").alias("model"), F.col("pooled").alias("predicted")).unionByName(p.select("grp", "measure", F.lit("highest").alias("model"), F.col("highest").alias("predicted")))
    return truth(spark, d).join(u, ["grp", "measure"]).select("grp", "measure", "replicate", "model", "observed", "predicted")


@query(f"WITH {TRUTH}, hi AS (SELECT * FROM pd WHERE highest > 0) SELECT grp, measure, replicate, {r('observed', 'pd.pooled', 'hi.highest')} FROM tr LEFT JOIN pd USING (grp, measure) LEFT JOIN hi USING (grp, measure)")
def join_widened_predictors(spark: SparkSession, d: str) -> DataFrame:
    """A column per predictor by left joins; pairs that a predictor lacks stay, with null."""
    p = predicted(spark, d)
    out = truth(spark, d)
    for one in (p.select("grp", "measure", "pooled"), p.filter("highest > 0").select("grp", "measure", "highest")):
        out = out.join(one, ["grp", "measure"], "left")
    return out


@query(f"WITH {TRUTH}, f AS (SELECT * FROM pd), a AS (SELECT * FROM pd WHERE highest > 0) SELECT grp, measure, {r('f.pooled')}, {r('a.highest')} FROM f JOIN a USING (grp, measure) WHERE f.pooled IS NOT NULL AND a.highest IS NOT NULL")
def join_complete_cases(spark: SparkSession, d: str) -> DataFrame:
    """Full model and ablation, pairs that have both and no null."""
    p = predicted(spark, d)
    both = p.select("grp", "measure", "pooled").join(p.filter("highest > 0").select("grp", "measure", "highest"), ["grp", "measure"])
    return sets.finite_rows(both, "pooled", "highest")


@query("SELECT s_suppkey, n_name, round(s_acctbal, 6) AS half_life FROM supplier JOIN (SELECT n_nationkey, upper(trim(n_name)) AS n_name FROM nation) ON s_nationkey = n_nationkey WHERE s_acctbal > 0")
def join_anchors(spark: SparkSession, d: str) -> DataFrame:
    """Anchors whose symbol (trimmed, upper case) is known, with a positive value."""
    n = table(spark, d, "nation").select("n_nationkey", F.upper(F.trim("n_name")).alias("n_name"))
    s = table(spark, d, "supplier").filter("s_acctbal > 0")
    return s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).select("s_suppkey", "n_name", F.col("s_acctbal").alias("half_life"))


@query("WITH h AS (SELECT lower(p_name) AS name, count(DISTINCT p_brand) AS brands, avg(CASE WHEN p_retailprice > 0 THEN p_retailprice END) AS price, count(*) AS n FROM part GROUP BY lower(p_name)) SELECT name, n, round(price, 6) AS price FROM h WHERE brands = 1")
def join_unambiguous(spark: SparkSession, d: str) -> DataFrame:
    """J15, J16, AGG52: names found whatever their case; a name of several brands gives no row; mean of positive values."""
    p = table(spark, d, "part").groupBy(F.lower("p_name").alias("name")).agg(F.countDistinct("p_brand").alias("brands"), F.avg(F.when(F.col("p_retailprice") > 0, F.col("p_retailprice"))).alias("price"), F.count("*").alias("n"))
    return p.filter("brands = 1").select("name", "n", "price")


@query("SELECT o_orderkey, coalesce(c_mktsegment, 'none') AS layer, c_custkey IS NOT NULL AS covered FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey")
def join_coverage_flag(spark: SparkSession, d: str) -> DataFrame:
    """J25, AGG55: attach what is covered, keep every row, and say which are."""
    c = table(spark, d, "customer").filter("c_acctbal > 0").select("c_custkey", "c_mktsegment")
    x = orders(spark, d).join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    return x.select("o_orderkey", F.coalesce("c_mktsegment", F.lit("none")).alias("layer"), F.col("c_custkey").isNotNull().alias("covered"))


@query("WITH m AS (SELECT user_id, event_type || '-' || user_id % 3 AS code FROM events), k AS (SELECT DISTINCT event_type AS key FROM events UNION SELECT 'view-1') SELECT user_id, code, coalesce(a.key, b.key) AS found, a.key IS NOT NULL AS whole FROM m LEFT JOIN k a ON a.key = code LEFT JOIN k b ON b.key = regexp_replace(code, '-[^-]*$', '')")
def join_id_or_stem(spark: SparkSession, d: str) -> DataFrame:
    """Look up the identifier, else the identifier without its last suffix."""
    m = table(spark, d, "events").select("user_id", F.concat_ws("-", "event_type", F.col("user_id") % 3).alias("code"))
    k = table(spark, d, "events").select(F.col("event_type").alias("key")).union(spark.createDataFrame([("view-1",)], "key string")).distinct()
    x = m.join(k.withColumnRenamed("key", "a"), F.col("a") == F.col("code"), "left").join(k.withColumnRenamed("key", "b"), F.col("b") == F.regexp_replace("code", "-[^-]*$", ""), "left")
    return x.select("user_id", "code", F.coalesce("a", "b").alias("found"), F.col("a").isNotNull().alias("whole"))


@query("WITH a AS (SELECT l_suppkey AS r, l_partkey % 20 AS c, sum(l_quantity) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL), b AS (SELECT l_suppkey AS r, l_partkey % 20 AS c, sum(l_tax) AS v FROM lineitem WHERE l_returnflag = 'N' AND l_partkey % 20 < 15 GROUP BY ALL), rr AS (SELECT DISTINCT r FROM a INTERSECT SELECT DISTINCT r FROM b), cc AS (SELECT DISTINCT c FROM a INTERSECT SELECT DISTINCT c FROM b) SELECT r, c, round(coalesce(a.v, 0), 6) AS x, round(coalesce(b.v, 0), 6) AS y FROM rr CROSS JOIN cc LEFT JOIN a USING (r, c) LEFT JOIN b USING (r, c)")
def join_both_axes(spark: SparkSession, d: str) -> DataFrame:
    """Two matrices on the rows and columns that both have, by name; absent cells are 0."""
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("r"), (F.col("l_partkey") % 20).alias("c"), "l_quantity", "l_tax", "l_returnflag")
    a = li.filter("l_returnflag = 'R'").groupBy("r", "c").agg(F.sum("l_quantity").alias("x"))
    b = li.filter("l_returnflag = 'N' and c < 15").groupBy("r", "c").agg(F.sum("l_tax").alias("y"))
    rr, cc = (a.select(k).distinct().join(b.select(k).distinct(), k) for k in "rc")
    grid = rr.crossJoin(F.broadcast(cc))  # the result's own size
    return grid.join(a, ["r", "c"], "left").join(b, ["r", "c"], "left").fillna(0.0, ["x", "y"])


@query("WITH al AS (SELECT n_nationkey AS pos, lower(n_name) AS alias FROM nation UNION SELECT n_nationkey, 'n' || n_nationkey FROM nation), ed AS (SELECT DISTINCT 'n' || s_nationkey AS src, lower(n_name) AS dst FROM supplier, nation WHERE n_regionkey = s_suppkey % 5) SELECT x.pos AS i, y.pos AS j, count(*) AS n FROM ed JOIN al x ON x.alias = src JOIN al y ON y.alias = dst GROUP BY ALL")
def join_edges_by_alias(spark: SparkSession, d: str) -> DataFrame:
    """J33, STR19: both ends of an edge list looked up among all aliases of the positions."""
    n = table(spark, d, "nation")
    alias = n.select(F.col("n_nationkey").alias("pos"), F.explode(F.array(F.lower("n_name"), F.concat(F.lit("n"), "n_nationkey"))).alias("alias")).distinct()
    s = table(spark, d, "supplier").select(F.concat(F.lit("n"), "s_nationkey").alias("src"), (F.col("s_suppkey") % 5).cast("int").alias("n_regionkey"))
    ed = s.join(n, "n_regionkey").select("src", F.lower("n_name").alias("dst")).distinct()
    x = ed.join(alias.select(F.col("pos").alias("i"), F.col("alias").alias("src")), "src").join(alias.select(F.col("pos").alias("j"), F.col("alias").alias("dst")), "dst")
    return x.groupBy("i", "j").agg(F.count("*").alias("n"))


@query("WITH a AS (SELECT o_custkey AS run, round(avg(o_totalprice), 6) AS mean FROM orders GROUP BY o_custkey), h AS (SELECT user_id AS run, min(event_type) AS setting FROM events GROUP BY user_id) SELECT run, mean, setting FROM a LEFT JOIN h USING (run)")
def join_settings_onto_runs(spark: SparkSession, d: str) -> DataFrame:
    """Settings, one row per run, left-joined to the runs' aggregates."""
    a = orders(spark, d).groupBy(F.col("o_custkey").alias("run")).agg(F.avg("o_totalprice").alias("mean"))
    return a.join(table(spark, d, "events").groupBy(F.col("user_id").alias("run")).agg(F.min("event_type").alias("setting")), "run", "left")


@query(f"WITH {CELLS}, n AS (SELECT arm, seed, count(*) AS n, avg(metric) AS m FROM c GROUP BY ALL) SELECT seed, arm, n FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY n DESC, m, arm) AS k FROM n) WHERE k = 1")
def pick_best_covered(spark: SparkSession, d: str) -> DataFrame:
    """Per seed the arm with most cells, ties by smaller mean and name."""
    n = cells_of(spark, d).groupBy("arm", "seed").agg(F.count("*").alias("n"), F.avg("metric").alias("m"))
    return n.groupBy("seed").agg(F.min(F.struct(-F.col("n"), "m", "arm", "n")).alias("b")).select("seed", "b.arm", "b.n")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND ('0x' || substr(md5('5:' || c_custkey), 1, 13))::BIGINT / 4503599627370496.0 < 0.2 AND c_custkey IN (SELECT o_custkey FROM orders)")
def join_validation_slice(spark: SparkSession, d: str) -> DataFrame:
    """J42, SPL8: a seeded slice drawn only inside the eligible rows."""
    from ..operators.splits import hash_fraction

    c = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").filter(hash_fraction("c_custkey", 5) < 0.2)
    return c.join(orders(spark, d), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query(f"WITH {EFFECTS} SELECT grp, replicate, measure, {r('delta')} FROM (SELECT * FROM eff ORDER BY abs(delta) DESC, grp, replicate, measure LIMIT 20)")
def top_effects(spark: SparkSession, d: str) -> DataFrame:
    """The 20 largest effects by size."""
    return effects_of(spark, d).select("grp", "replicate", "measure", "delta").orderBy(F.abs("delta").desc(), "grp", "replicate", "measure").limit(20)


@query("SELECT o_orderpriority, o_orderkey, round(o_totalprice, 6) AS price, k::INT AS k FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 3")
def top_three_per_group(spark: SparkSession, d: str) -> DataFrame:
    """The three largest of each group; each task first keeps three of each group, so no group is sorted whole."""
    best = F.struct((-F.col("o_totalprice")).alias("m"), "o_orderkey", F.col("o_totalprice").alias("price"))
    salted = orders(spark, d).withColumn("salt", F.pmod(F.xxhash64("o_orderkey"), F.lit(64)))
    first = lambda key: F.row_number().over(W.partitionBy(*key).orderBy(best["m"], best["o_orderkey"]))
    few = salted.withColumn("k", first(["o_orderpriority", "salt"])).filter("k <= 3")
    return few.withColumn("k", first(["o_orderpriority"])).filter("k <= 3").select("o_orderpriority", "o_orderkey", F.col("o_totalprice").alias("price"), "k")


@query(f"WITH {EFFECTS}, m AS (SELECT measure, grp, avg(delta) AS d FROM eff GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY measure ORDER BY d, grp) AS lo, row_number() OVER (PARTITION BY measure ORDER BY d DESC, grp) AS hi, (rank() OVER (PARTITION BY measure ORDER BY d) - 1) / count(*) OVER (PARTITION BY measure) AS place FROM m) SELECT measure, grp, {r('d', 'place')}, lo <= 1 AS is_lowest, hi <= 1 AS is_highest FROM k")
def panel_places(spark: SparkSession, d: str) -> DataFrame:
    """Each label's place as a share of its panel, and whether it is the smallest or largest."""
    m = effects_of(spark, d).groupBy("measure", "grp").agg(F.avg("delta").alias("d"))
    w = W.partitionBy("measure")
    place = (F.rank().over(w.orderBy("d")) - 1) / F.count("*").over(w)
    return m.select("measure", "grp", "d", place.alias("place"), (F.row_number().over(w.orderBy("d", "grp")) <= 1).alias("is_lowest"), (F.row_number().over(w.orderBy(F.desc("d"), "grp")) <= 1).alias("is_highest"))


@query(f"WITH {CELLS}, s AS (SELECT arm, seed, avg(metric) AS m FROM c GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY m, seed) AS k, count(*) OVER (PARTITION BY arm) AS n FROM s) SELECT arm, seed, {r('m')} FROM k WHERE k = n // 2 + 1")
def pick_median_run(spark: SparkSession, d: str) -> DataFrame:
    """Per arm the run whose score is the upper median element."""
    s = cells_of(spark, d).groupBy("arm", "seed").agg(F.avg("metric").alias("m"))
    w = W.partitionBy("arm")
    x = s.withColumn("k", F.row_number().over(w.orderBy("m", "seed"))).withColumn("n", F.count("*").over(w))
    return x.filter(F.col("k") == F.floor(F.col("n") / 2) + 1).select("arm", "seed", "m")


@query(f"WITH {CELLS} SELECT min(seed)::BIGINT AS seed FROM (SELECT seed FROM c WHERE arm IN ('view', 'click', 'purchase') GROUP BY seed HAVING count(DISTINCT arm) = 3)")
def pick_matched_run(spark: SparkSession, d: str) -> DataFrame:
    """The first key for which every requested model has a run."""
    want = ("view", "click", "purchase")
    return cells_of(spark, d).filter(F.col("arm").isin(*want)).groupBy("seed").agg(F.countDistinct("arm").alias("n")).filter(F.col("n") == len(want)).agg(F.min("seed").alias("seed"))


@query("SELECT 'orders' AS part, o_custkey AS id, o_totalprice AS price, NULL::VARCHAR AS segment FROM orders UNION ALL SELECT 'customer', c_custkey, NULL, c_mktsegment FROM customer")
def set_union_by_name(spark: SparkSession, d: str) -> DataFrame:
    """SET1, SET12: rows of all parts, columns by name, what a part lacks is null."""
    a = orders(spark, d).select(F.lit("orders").alias("part"), F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("price"))
    b = table(spark, d, "customer").select(F.lit("customer").alias("part"), F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    return a.unionByName(b, allowMissingColumns=True)


@query("SELECT s_nationkey AS nation, 'supplier' AS side FROM supplier UNION SELECT c_nationkey, 'customer' FROM customer UNION SELECT c_nationkey, 'customer' FROM customer")
def set_union_distinct(spark: SparkSession, d: str) -> DataFrame:
    """SET9: union without repeats on the key columns."""
    a = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.lit("supplier").alias("side"))
    b = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.lit("customer").alias("side"))
    return a.union(b).union(b).distinct()


@query("WITH a AS (SELECT o_custkey AS id, min(o_orderstatus) AS status, max(o_orderpriority) AS pr FROM orders GROUP BY o_custkey), b AS (SELECT o_custkey AS id, max(o_orderstatus) AS status, max(o_orderpriority) AS pr FROM orders GROUP BY o_custkey) SELECT id, CASE WHEN a.status = b.status THEN a.status END AS status, CASE WHEN a.pr = b.pr THEN a.pr END AS priority FROM a JOIN b USING (id)")
def set_agreeing_columns(spark: SparkSession, d: str) -> DataFrame:
    """SET3: rows that all parts have, with the values on which all parts agree."""
    o = orders(spark, d).groupBy(F.col("o_custkey").alias("id"))
    a, b = o.agg(F.min("o_orderstatus").alias("s1"), F.max("o_orderpriority").alias("p1")), o.agg(F.max("o_orderstatus").alias("s2"), F.max("o_orderpriority").alias("p2"))
    same = lambda x, y: F.when(F.col(x) == F.col(y), F.col(x))
    return a.join(b, "id").select("id", same("s1", "s2").alias("status"), same("p1", "p2").alias("priority"))
