"""Which rows, columns and names count: masks, labels, splits, permutations, fingerprints, cleaned names.

Bindings: units = customers or suppliers, features = part keys modulo 50, layers = return flags, run table = events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.strings import missing_to_null
from ..operators.ranks import numbered
from ..operators.splits import hash_fraction
from ..sources.shared import write_table
from ..sources.tables import table
from .effects import EFFECTS, effects_of, r
from .registry import query
from .runs import CELLS, cells_of

MD5 = "('0x' || substr(md5('{0}:' || {1}), 1, 13))::BIGINT / 4503599627370496.0"
COUNTS = "x AS (SELECT l_suppkey AS r, l_partkey % 50 AS c, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS s, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS u FROM lineitem GROUP BY ALL)"


def counts(spark: SparkSession, d: str) -> DataFrame:
    """(r, c, s, u): two layers of one matrix."""
    li = table(spark, d, "lineitem")
    layer = lambda f: F.sum(F.when(F.col("l_returnflag") == f, F.col("l_quantity")).otherwise(0.0))
    return li.groupBy(F.col("l_suppkey").alias("r"), (F.col("l_partkey") % 50).alias("c")).agg(layer("R").alias("s"), layer("A").alias("u"))


def customers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer")


@query(f"WITH {COUNTS} SELECT c, count_if(s > 0) + count_if(u > 0) AS shared, count_if(s > 0) + count_if(u > 0) >= 3 OR c IN (1, 2) AS used FROM x WHERE r % 2 = 0 GROUP BY c")
def mask_shared_counts(spark: SparkSession, d: str) -> DataFrame:
    """PF8, AGG57: features with enough non-zero rows over both layers among the control rows, and those to retain."""
    n = F.count_if(F.col("s") > 0) + F.count_if(F.col("u") > 0)
    return counts(spark, d).filter("r % 2 = 0").groupBy("c").agg(n.alias("shared"), ((n >= 3) | F.col("c").isin(1, 2)).alias("used"))


@query(f"WITH {COUNTS} SELECT c, sum(s) >= 20 AND sum(u) >= 20 AS usable, round(CASE WHEN sum(s) + sum(u) > 0 THEN sum(u) / (sum(s) + sum(u)) ELSE 0 END, 6) AS unspliced FROM x GROUP BY c")
def mask_usable_features(spark: SparkSession, d: str) -> DataFrame:
    """PF9, AGG116: features whose sums suffice in both layers, and the share of the second layer."""
    s, u = F.sum("s"), F.sum("u")
    return counts(spark, d).groupBy("c").agg(((s >= 20) & (u >= 20)).alias("usable"), F.when(s + u > 0, u / (s + u)).otherwise(0.0).alias("unspliced"))


@query(f"SELECT c_custkey, c_mktsegment NOT IN ('BUILDING', 'MACHINERY') AS by_group, {MD5.format(3, 'c_custkey')} < 0.1 AS at_random, c_mktsegment NOT IN ('BUILDING', 'MACHINERY') OR {MD5.format(3, 'c_custkey')} < 0.1 AS held_out FROM customer")
def mask_held_out(spark: SparkSession, d: str) -> DataFrame:
    """PF11, PF12, PF13, PF14, SPL2, SPL3: rows outside the allowed groups, the seeded slice, and the union; the rest is fitted."""
    g, a = ~F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), hash_fraction("c_custkey", 3) < 0.1
    return customers(spark, d).select("c_custkey", g.alias("by_group"), a.alias("at_random"), (g | a).alias("held_out"))


@query(f"SELECT c_custkey, {MD5.format(3, 'c_custkey')} >= 0.1 AND c_acctbal > 0 AND c_custkey IN (SELECT o_custkey FROM orders) AS fits FROM customer")
def mask_preprocessing_rows(spark: SparkSession, d: str) -> DataFrame:
    """PF10, PF19, PF21: rows that may fit statistics: in training, of the side, and measured."""
    measured = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("m", F.lit(True))
    c = customers(spark, d).join(measured, "c_custkey", "left")
    return c.select("c_custkey", ((hash_fraction("c_custkey", 3) >= 0.1) & (F.col("c_acctbal") > 0) & F.coalesce("m", F.lit(False))).alias("fits"))


@query(f"WITH {EFFECTS}, p AS (SELECT grp, measure, avg(delta) AS delta, count(*) AS n FROM eff GROUP BY ALL) SELECT grp, measure AS target, {r('delta')}, n >= 3 AS sufficient FROM p WHERE abs(delta) > 0.001 AND grp <> '1-URGENT'")
def scoring_set(spark: SparkSession, d: str) -> DataFrame:
    """PF16, PF17, PF18: pairs with an effect that aren't excluded, renamed, with the flag of a sufficient design."""
    p = effects_of(spark, d).groupBy("grp", "measure").agg(F.avg("delta").alias("delta"), F.count("*").alias("n"))
    return p.filter((F.abs("delta") > 0.001) & (F.col("grp") != "1-URGENT")).select("grp", F.col("measure").alias("target"), "delta", (F.col("n") >= 3).alias("sufficient"))


@query(f"WITH {CELLS} SELECT arm, count(*) AS n, coalesce(max(abs(metric)) <= 1e-12, false) AND count(*) >= 2 AS degenerate, coalesce(min(metric) < 1, false) AS collapsed FROM c GROUP BY arm")
def runs_degenerate(spark: SparkSession, d: str) -> DataFrame:
    """PF28, PF29: arms with a metric below a threshold, and arms of two runs or more that are all about zero."""
    big = F.coalesce(F.max(F.abs("metric")) <= 1e-12, F.lit(False)) & (F.count("*") >= 2)
    return cells_of(spark, d).groupBy("arm").agg(F.count("*").alias("n"), big.alias("degenerate"), F.coalesce(F.min("metric") < 1, F.lit(False)).alias("collapsed"))


@query("""SELECT event_id, CASE WHEN event_type IN ('view', 'click') AND value >= 50 THEN 'both' WHEN event_type IN ('view', 'click') THEN 'type only' WHEN value >= 50 THEN 'value only' ELSE 'neither' END AS regime,
  CASE WHEN value IS NULL THEN 'unknown' WHEN value < 10 THEN 'stuck' WHEN value < 40 THEN 'slow' ELSE 'fine' END AS state, coalesce(nullif(event_type, 'error'), 'test') AS fitted, event_type || '@' || CAST(user_id % 5 AS VARCHAR) AS arm FROM events""")
def label_runs(spark: SparkSession, d: str) -> DataFrame:
    """PF43 to PF51: labels of runs by ordered cases: regime of two flags, state by thresholds with a null branch, coalesced side, composed arm."""
    t, v = F.col("event_type").isin("view", "click"), F.col("value") >= 50
    v_known = F.coalesce(v, F.lit(False))
    regime = F.when(t & v_known, "both").when(t, "type only").when(v_known, "value only").otherwise("neither")
    state = F.when(F.col("value").isNull(), "unknown").when(F.col("value") < 10, "stuck").when(F.col("value") < 40, "slow").otherwise("fine")
    side = F.coalesce(F.when(F.col("event_type") != "error", F.col("event_type")), F.lit("test"))
    return table(spark, d, "events").select("event_id", regime.alias("regime"), state.alias("state"), side.alias("fitted"), F.concat("event_type", F.lit("@"), (F.col("user_id") % 5).cast("string")).alias("arm"))


@query("SELECT p_partkey, CASE WHEN contains(p_type, 'STEEL') THEN 'steel' WHEN contains(p_type, 'BRASS') OR contains(p_type, 'COPPER') THEN 'alloy' WHEN contains(p_type, 'TIN') THEN 'tin' ELSE 'other' END AS lineage, CASE p_brand WHEN 'Brand#11' THEN 'first' WHEN 'Brand#12' THEN 'second' ELSE 'rest' END AS family FROM part")
def label_lineage(spark: SparkSession, d: str) -> DataFrame:
    """PF52, PF53: ordered substring cases, and a dictionary with a default."""
    has = lambda s: F.contains(F.col("p_type"), F.lit(s))
    line = F.when(has("STEEL"), "steel").when(has("BRASS") | has("COPPER"), "alloy").when(has("TIN"), "tin").otherwise("other")
    family = F.when(F.col("p_brand") == "Brand#11", "first").when(F.col("p_brand") == "Brand#12", "second").otherwise("rest")
    return table(spark, d, "part").select("p_partkey", line.alias("lineage"), family.alias("family"))


@query("SELECT p_name, p_partkey, k = 1 AS kept FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS k FROM part)")
def names_first_kept(spark: SparkSession, d: str) -> DataFrame:
    """PF40, W8: the first occurrence of each name is kept, later ones are told apart."""
    first = table(spark, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("first"))
    return table(spark, d, "part").select("p_name", "p_partkey").join(first, "p_name").select("p_name", "p_partkey", (F.col("p_partkey") == F.col("first")).alias("kept"))


@query("WITH t AS (SELECT event_type AS run, CASE WHEN event_type IN ('purchase', 'signup') THEN 0 WHEN event_type LIKE 'c%' THEN 1 ELSE 2 END AS tier, count(*) AS n FROM events GROUP BY ALL) SELECT run, tier, row_number() OVER (ORDER BY tier, n DESC, run) AS place FROM t")
def runs_preference(spark: SparkSession, d: str) -> DataFrame:
    """PF41: order of preference of runs: tier, then size, then name (one row per kind of run)."""
    tier = F.when(F.col("event_type").isin("purchase", "signup"), 0).when(F.col("event_type").startswith("c"), 1).otherwise(2)
    t = table(spark, d, "events").groupBy(F.col("event_type").alias("run"), tier.alias("tier")).agg(F.count("*").alias("n"))
    return t.withColumn("place", F.row_number().over(W.orderBy("tier", F.desc("n"), "run"))).drop("n")


@query(f"WITH {COUNTS} SELECT c, stddev_pop(s) > 1e-9 AS varies FROM x GROUP BY c")
def mask_varying_columns(spark: SparkSession, d: str) -> DataFrame:
    """PF42: columns that aren't constant."""
    return counts(spark, d).groupBy("c").agg((F.stddev_pop("s") > 1e-9).alias("varies"))


@query("SELECT event_id, trim(lower(CASE WHEN value > 50 THEN 'True' WHEN value < 20 THEN ' no ' ELSE '' END)) IN ('true', '1', 'yes') AS flag, trim(CASE WHEN value > 50 THEN 'True' WHEN value < 20 THEN ' no ' ELSE '' END) = '' AS blank FROM events")
def text_flags(spark: SparkSession, d: str) -> DataFrame:
    """PF24, PF25, STR24: texts as booleans, and the test for a blank."""
    t = F.when(F.col("value") > 50, "True").when(F.col("value") < 20, " no ").otherwise("")
    return table(spark, d, "events").select("event_id", F.lower(F.trim(t)).isin("true", "1", "yes").alias("flag"), missing_to_null(t).isNull().alias("blank"))


SUBSETS = "WITH a AS (SELECT p_partkey, p_size > 25 AS kinetic, p_retailprice > 1000 AS aligned, p_brand LIKE '%1' AS anchored FROM part) "


@query(SUBSETS + "SELECT p_partkey, concat_ws('+', CASE WHEN kinetic THEN 'kinetic' END, CASE WHEN aligned THEN 'aligned' END, CASE WHEN anchored THEN 'anchored' END) AS subsets, kinetic::INT * aligned::INT * anchored::INT AS weight FROM a")
def mask_subsets(spark: SparkSession, d: str) -> DataFrame:
    """PF32, PF33, PF34: boolean subsets of features and their product as a weight."""
    k, a, n = F.col("p_size") > 25, F.col("p_retailprice") > 1000, F.col("p_brand").endswith("1")
    return table(spark, d, "part").select("p_partkey", F.concat_ws("+", F.when(k, "kinetic"), F.when(a, "aligned"), F.when(n, "anchored")).alias("subsets"), (k.cast("int") * a.cast("int") * n.cast("int")).alias("weight"))


@query("SELECT s_suppkey, regexp_replace(s_name, '^Supplier#0*', 'S') AS run, ends_with(s_name, '1') OR starts_with(s_name, 'X') AS marked FROM supplier")
def names_normalised_prefix(spark: SparkSession, d: str) -> DataFrame:
    """PF35, PF39: prefixes of identifiers normalised, and a test on any of several name forms."""
    n = F.col("s_name")
    return table(spark, d, "supplier").select("s_suppkey", F.regexp_replace(n, "^Supplier#0*", "S").alias("run"), (n.endswith("1") | n.startswith("X")).alias("marked"))


@query("SELECT vec_id, list_bool_and(list_transform(embedding, lambda x: isfinite(x))) AS finite FROM embeddings")
def mask_finite_vectors(spark: SparkSession, d: str) -> DataFrame:
    """PF36, PF15: rows whose components are all finite."""
    return table(spark, d, "embeddings").select("vec_id", F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))).alias("finite"))


def order_hash(seed: int, c: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(c).cast("string")))


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS place, row_number() OVER (ORDER BY md5('9:' || c_custkey), c_custkey) - 1 AS shuffled FROM customer")
def split_permutation(spark: SparkSession, d: str) -> DataFrame:
    """SPL12, SPL13, SPL14: each row's place and its place in the seeded permutation, which gives the inverse too."""
    x = numbered(customers(spark, d).select("c_custkey", order_hash(9, "c_custkey").alias("h")), F.col("h"), F.col("c_custkey"), out="p").drop("_part")
    return numbered(x, F.col("c_custkey")).select("c_custkey", (F.col("_r") - 1).alias("place"), (F.col("p") - 1).alias("shuffled"))


@query("SELECT c_custkey, (row_number() OVER (ORDER BY md5('9:' || c_custkey), c_custkey) - 1) // 128 AS batch FROM customer")
def split_batches(spark: SparkSession, d: str) -> DataFrame:
    """SPL19: a seeded order cut into batches of 128."""
    x = numbered(customers(spark, d).select("c_custkey", order_hash(9, "c_custkey").alias("h")), F.col("h"), F.col("c_custkey"))
    return x.select("c_custkey", F.floor((F.col("_r") - 1) / 128).alias("batch"))


@query("SELECT c_custkey, k <= 100 AS taken FROM (SELECT c_custkey, row_number() OVER (ORDER BY md5('4:' || c_custkey), c_custkey) AS k FROM customer)")
def split_subsample(spark: SparkSession, d: str) -> DataFrame:
    """SPL9, SPL11, SPL18, ARR4: a hundred rows without replacement, the head of one seeded permutation, the same on every side."""
    x = numbered(customers(spark, d).select("c_custkey", order_hash(4, "c_custkey").alias("h")), F.col("h"), F.col("c_custkey"))
    return x.select("c_custkey", (F.col("_r") <= 100).alias("taken"))


@query("WITH n AS (SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY ALL) SELECT c_custkey, CASE WHEN n < 10 THEN c_mktsegment ELSE c_mktsegment || '/' || c_nationkey END AS stratum FROM customer JOIN n USING (c_mktsegment, c_nationkey)")
def split_strata(spark: SparkSession, d: str) -> DataFrame:
    """SPL5: crossed strata; those of fewer than ten rows fold to their parent."""
    c = customers(spark, d)
    n = c.groupBy("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"))
    label = F.when(F.col("n") < 10, F.col("c_mktsegment")).otherwise(F.concat_ws("/", "c_mktsegment", "c_nationkey"))
    return c.join(n, ["c_mktsegment", "c_nationkey"]).select("c_custkey", label.alias("stratum"))


@query(f"SELECT c_custkey, CASE WHEN {MD5.format(6, 'c_custkey')} < 0.15 THEN 'validation' ELSE 'train' END AS part, true AS unchanged, ({MD5.format(6, 'c_custkey')} < 0.15) = ({MD5.format(7, 'c_custkey')} < 0.15) AS as_other_seed FROM customer WHERE c_acctbal > 0")
def split_frozen(spark: SparkSession, d: str) -> DataFrame:
    """SPL6, SPL7, SPL20: a split stored with the fitted rows, read back and compared with the one that its seed gives, and
    with another seed's, which must be told from it."""
    split = lambda seed: F.when(hash_fraction("c_custkey", seed) < 0.15, "validation").otherwise("train")
    stored = write_table(customers(spark, d).filter("c_acctbal > 0").select("c_custkey", split(6).alias("part")), "split")
    now = customers(spark, d).select("c_custkey", split(6).alias("own"), split(7).alias("other"))
    return stored.join(now, "c_custkey").select("c_custkey", "part", (F.col("part") == F.col("own")).alias("unchanged"), (F.col("part") == F.col("other")).alias("as_other_seed"))


@query("SELECT DISTINCT event_type, md5(event_type || '|7|11') AS mixed, md5('11|7|' || event_type) AS turned, substr(md5(concat_ws('|', event_type, 'a.parquet', 'v2')), 1, 12) AS prefix FROM events")
def hash_seeds(spark: SparkSession, d: str) -> DataFrame:
    """HSH1, HSH3: seeds mixed by a hash in which order counts, and the prefix of a cache entry."""
    e = F.col("event_type")
    x = table(spark, d, "events").select("event_type").distinct()
    return x.select("event_type", F.md5(F.concat(e, F.lit("|7|11"))).alias("mixed"), F.md5(F.concat(F.lit("11|7|"), e)).alias("turned"), F.substring(F.md5(F.concat_ws("|", e, F.lit("a.parquet"), F.lit("v2"))), 1, 12).alias("prefix"))


@query("WITH k AS (SELECT c_nationkey, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS s FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY c_nationkey) SELECT c_nationkey, sha256(s) AS fingerprint FROM k")
def hash_protocol(spark: SparkSession, d: str) -> DataFrame:
    """HSH6, ARR2: SHA-256 of a group's sorted settings without those of the intervention."""
    k = customers(spark, d).filter("c_mktsegment <> 'BUILDING'").groupBy("c_nationkey").agg(F.concat_ws(",", F.array_sort(F.collect_set("c_mktsegment"))).alias("s"))
    return k.select("c_nationkey", F.sha2("s", 256).alias("fingerprint"))


NAMES = "WITH n AS (SELECT s_suppkey, s_name || '_TotalSeqB' AS adt, 'batch_' || s_name || '-1' AS barcode, 'lib:' || s_suppkey || 'x' AS loom, ' ' || lower(s_name) || ' ' AS symbol FROM supplier) "


@query(NAMES + "SELECT s_suppkey, regexp_replace(adt, '_TotalSeq[A-Z]$', '') AS protein, upper(trim(symbol)) AS symbol, split_part(split_part(barcode, '_', 2), '-', 1) AS core, replace(split_part(loom, ':', 2), 'x', '-1') AS barcode, upper(regexp_replace(regexp_replace(adt, '_TotalSeq[A-Z]$', ''), '[^A-Za-z0-9]', '', 'g')) AS feature_key FROM n")
def str_identifiers(spark: SparkSession, d: str) -> DataFrame:
    """STR3, STR4, STR5, STR10, STR14, STR16, STR18: suffixes stripped, symbols trimmed, barcode cores, cleaned barcodes, keys."""
    n = table(spark, d, "supplier")
    adt, barcode, loom = F.concat("s_name", F.lit("_TotalSeqB")), F.concat(F.lit("batch_"), "s_name", F.lit("-1")), F.concat(F.lit("lib:"), "s_suppkey", F.lit("x"))
    protein = F.regexp_replace(adt, "_TotalSeq[A-Z]$", "")
    return n.select(
        "s_suppkey", protein.alias("protein"), F.upper(F.trim(F.concat(F.lit(" "), F.lower("s_name"), F.lit(" ")))).alias("symbol"),
        F.substring_index(F.substring_index(barcode, "_", -1), "-", 1).alias("core"), F.regexp_replace(F.substring_index(loom, ":", -1), "x", "-1").alias("barcode"),
        F.upper(F.regexp_replace(protein, "[^A-Za-z0-9]", "")).alias("feature_key"),
    )


@query("""WITH k AS (SELECT DISTINCT upper(n_name) AS symbol FROM nation WHERE n_regionkey <> 2), s AS (SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'control' ELSE n_name END AS name FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT c_custkey, name, CASE WHEN name = 'control' THEN NULL ELSE k.symbol END AS symbol, CASE WHEN name = 'control' THEN 'isotype' WHEN k.symbol IS NOT NULL THEN 'dictionary' ELSE 'unmapped' END AS reason FROM s LEFT JOIN k ON k.symbol = upper(name)""")
def map_markers(spark: SparkSession, d: str) -> DataFrame:
    """STR21, STR22, STR23, J17, J19: markers resolved in order: controls, then the dictionary, else unmapped, with the reason."""
    n = table(spark, d, "nation")
    k = n.filter("n_regionkey <> 2").select(F.upper("n_name").alias("symbol")).distinct()
    s = customers(spark, d).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.when(F.col("c_mktsegment") == "BUILDING", "control").otherwise(F.col("n_name")).alias("name"))
    x = s.join(F.broadcast(k), F.upper("name") == F.col("symbol"), "left")
    control = F.col("name") == "control"
    return x.select("c_custkey", "name", F.when(~control, F.col("symbol")).alias("symbol"), F.when(control, "isotype").when(F.col("symbol").isNotNull(), "dictionary").otherwise("unmapped").alias("reason"))


@query("""SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS as_int, json_extract_string(props, '$.k') IN ('true', 'false') AS is_bool, coalesce(TRY_CAST(regexp_extract(props, 'seed_?([0-9]+)', 1) AS BIGINT), event_id % 7) AS seed,
  CASE WHEN event_type = 'view' THEN 'train' WHEN props LIKE '%stage%' THEN 'staged' ELSE 'default' END AS stage, concat_ws('|', event_type, user_id) AS cell_key FROM events""")
def str_run_settings(spark: SparkSession, d: str) -> DataFrame:
    """STR25, STR26, STR28, STR29, STR31: typed values, seeds from text or else from the table, stages by ordered rules, canonical keys."""
    k = F.get_json_object("props", "$.k")
    seed = F.coalesce(F.regexp_extract("props", "seed_?([0-9]+)", 1).try_cast("long"), F.col("event_id") % 7)
    stage = F.when(F.col("event_type") == "view", "train").when(F.col("props").contains("stage"), "staged").otherwise("default")
    return table(spark, d, "events").select("event_id", k.try_cast("long").alias("as_int"), k.isin("true", "false").alias("is_bool"), seed.alias("seed"), stage.alias("stage"), F.concat_ws("|", "event_type", "user_id").alias("cell_key"))


@query("WITH n AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL) SELECT c_nationkey, string_agg(c_mktsegment || '=' || round(n / t, 4)::DECIMAL(10, 4), ',' ORDER BY c_mktsegment) AS shares FROM n JOIN (SELECT c_nationkey, sum(n) AS t FROM n GROUP BY c_nationkey) USING (c_nationkey) GROUP BY c_nationkey")
def shares_by_group(spark: SparkSession, d: str) -> DataFrame:
    """ARR1: the shares of each group's values as an ordered dictionary."""
    n = customers(spark, d).groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    x = n.withColumn("t", F.sum("n").over(W.partitionBy("c_nationkey")))
    entry = F.concat("c_mktsegment", F.lit("="), F.round(F.col("n") / F.col("t"), 4).cast("decimal(10,4)").cast("string"))
    return x.groupBy("c_nationkey").agg(F.concat_ws(",", F.array_sort(F.collect_list(entry))).alias("shares"))


@query("WITH e AS (SELECT l_suppkey AS src, l_partkey % 50 AS dst, sum(l_quantity) AS w FROM lineitem GROUP BY ALL), s AS (SELECT src, dst, CASE WHEN src = 3 AND abs(w) > 0.001 THEN 0 ELSE w END AS w FROM e) SELECT src, dst, round(CASE WHEN sum(w) OVER (PARTITION BY src) > 0 THEN w / sum(w) OVER (PARTITION BY src) ELSE 0 END, 6) AS w FROM s")
def graph_silenced(spark: SparkSession, d: str) -> DataFrame:
    """ARR5, ARR8, AGG114: the outgoing links of one node set to zero, the others' weights over their row sum."""
    e = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 50).alias("dst")).agg(F.sum("l_quantity").alias("w"))
    s = e.withColumn("w", F.when((F.col("src") == 3) & (F.abs("w") > 0.001), 0.0).otherwise(F.col("w")))
    total = F.sum("w").over(W.partitionBy("src"))
    return s.select("src", "dst", F.when(total > 0, F.col("w") / total).otherwise(0.0).alias("w"))


@query("WITH a AS (SELECT user_id, min(event_type) AS kind, max(value) AS score FROM events GROUP BY user_id), b AS (SELECT c_custkey AS user_id, c_mktsegment AS kind FROM customer WHERE c_custkey % 2 = 0) SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(b.kind, a.kind) AS kind, round(score, 6) AS score FROM a FULL JOIN b USING (user_id)")
def overlay_maps(spark: SparkSession, d: str) -> DataFrame:
    """JSN1, JSN3: an overlay of two maps by key: the second wins where it has a value, defaults fill the rest."""
    a = table(spark, d, "events").groupBy("user_id").agg(F.min("event_type").alias("k1"), F.max("value").alias("score"))
    b = customers(spark, d).filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("k2"))
    return a.join(b, "user_id", "full").select("user_id", F.coalesce("k2", "k1").alias("kind"), "score")
