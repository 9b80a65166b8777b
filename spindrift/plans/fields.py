"""Agreement of two vector fields and of neighbourhoods: row, column and whole-table measures on the embedding pairs.

As in ``vectors``: modality 1 = first half, partner = id plus half, searches ask with ids divisible by 20.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import average_rank, pearson, ratio
from ..operators import diffusion, graphs, index, profiles, resampling, vectors
from ..sources.shared import write_table
from .registry import query
from .vectors import HALF, LONG, NEAR, PAIR, fos, long_pairs, near, pairs, rows


def doubles(c: str) -> Column:
    return F.transform(c, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def centred(v: Column) -> Column:
    mean = F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)
    return F.transform(v, lambda x: x - mean)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 where one has no length."""
    length = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(length > 0, dot(a, b) / F.when(length > 0, length)).otherwise(0.0)


def both(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d).select("id", "grp", doubles("a").alias("a"), doubles("b").alias("b"))


NORMS = PAIR + ", nr AS (SELECT id, grp, sqrt(list_inner_product(a, a)) AS na, sqrt(list_inner_product(b, b)) AS nb FROM pr)"


def norms(spark: SparkSession, d: str) -> DataFrame:
    x = both(spark, d)
    return x.select("id", "grp", F.sqrt(dot(F.col("a"), F.col("a"))).alias("na"), F.sqrt(dot(F.col("b"), F.col("b"))).alias("nb"))


@query(f"WITH {PAIR} SELECT id, round(list_cosine_similarity(a, b), 6) + 0.0 AS cosine FROM pr")
def vec_row_cosine(spark: SparkSession, d: str) -> DataFrame:
    """AGG90, AGG98: cosine of each row with its partner."""
    return both(spark, d).select("id", cosine(F.col("a"), F.col("b")).alias("cosine"))


@query(f"WITH {PAIR} SELECT id, round(list_cosine_similarity(list_transform(a, lambda x: x - list_avg(a)), list_transform(b, lambda x: x - list_avg(b))), 6) + 0.0 AS pearson FROM pr")
def vec_row_pearson(spark: SparkSession, d: str) -> DataFrame:
    """AGG91: cosine of each row with its partner, both centred."""
    c = both(spark, d).select("id", centred(F.col("a")).alias("a"), centred(F.col("b")).alias("b"))
    return c.select("id", cosine(F.col("a"), F.col("b")).alias("pearson"))


@query(f"WITH {LONG} SELECT dim, round(sum(predicted * observed) / sqrt(sum(predicted ^ 2) * sum(observed ^ 2)), 6) + 0.0 AS cosine FROM lg GROUP BY dim")
def vec_column_cosine(spark: SparkSession, d: str) -> DataFrame:
    """AGG97: cosine of each column between the two fields."""
    p, o = F.col("predicted"), F.col("observed")
    return long_pairs(spark, d).groupBy("dim").agg(ratio(F.sum(p * o), F.sqrt(F.sum(p * p) * F.sum(o * o))).alias("cosine"))


@query(f"""WITH {LONG}, rk AS (SELECT dim, rank() OVER (PARTITION BY dim ORDER BY predicted) + (count(*) OVER (PARTITION BY dim, predicted) - 1) / 2.0 AS x,
  rank() OVER (PARTITION BY dim ORDER BY observed) + (count(*) OVER (PARTITION BY dim, observed) - 1) / 2.0 AS y FROM lg)
SELECT dim, round(corr(x, y), 6) + 0.0 AS spearman FROM rk GROUP BY dim""")
def vec_column_spearman(spark: SparkSession, d: str) -> DataFrame:
    """AGG88: rank correlation of each column; ties share their mean rank."""
    r = long_pairs(spark, d).withColumns({"x": average_rank("predicted", "dim"), "y": average_rank("observed", "dim")})
    return r.groupBy("dim").agg(pearson("x", "y").alias("spearman"))


@query(f"WITH {NORMS} SELECT grp, count(*) AS n, round(exp(quantile_cont(ln(nb / na), 0.25)), 6) AS q25, round(exp(quantile_cont(ln(nb / na), 0.5)), 6) AS q50, round(exp(quantile_cont(ln(nb / na), 0.75)), 6) AS q75 FROM nr WHERE na > 0 AND nb > 0 GROUP BY grp")
def vec_log_norm_ratio(spark: SparkSession, d: str) -> DataFrame:
    """AGG40: exp of quantiles of log ratios of norms over rows where both have a length."""
    x = norms(spark, d).filter("na > 0 and nb > 0").select("grp", F.log(F.col("nb") / F.col("na")).alias("value"))
    q = profiles.exact_quantiles(x, ["grp"], "value", (0.25, 0.5, 0.75))
    wide = q.groupBy("grp").agg(F.first("n").alias("n"), *(F.exp(F.max(F.when(F.col("share") == s, F.col("quantile")))).alias(f"q{round(100 * s)}") for s in (0.25, 0.5, 0.75)))
    return wide


@query(f"WITH {NORMS} SELECT round(quantile_cont(nb, 0.5) FILTER (nb > 0) / quantile_cont(na, 0.5) FILTER (na > 0), 6) AS ratio FROM nr")
def vec_median_norm_ratio(spark: SparkSession, d: str) -> DataFrame:
    """AGG99: ratio of the medians of norms that aren't zero."""
    x = norms(spark, d).select(F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("na").alias("value")), F.struct(F.lit("b").alias("side"), F.col("nb").alias("value")))).alias("s"))
    q = profiles.exact_quantiles(x.select("s.side", "s.value").filter("value > 0"), ["side"], "value", (0.5,))
    return q.agg((F.max(F.when(F.col("side") == "b", F.col("quantile"))) / F.max(F.when(F.col("side") == "a", F.col("quantile")))).alias("ratio"))


@query(f"WITH {NORMS} SELECT grp, count(*) AS n, round(avg((na = 0 OR nb = 0)::INT), 6) AS zero_share FROM nr GROUP BY grp")
def vec_zero_norm_share(spark: SparkSession, d: str) -> DataFrame:
    """AGG46: share of rows of which one side has no length."""
    return norms(spark, d).groupBy("grp").agg(F.count("*").alias("n"), F.avg(((F.col("na") == 0) | (F.col("nb") == 0)).cast("int")).alias("zero_share"))


@query(f"""WITH {LONG} SELECT dim, round(avg((sign(predicted) = sign(observed))::INT), 6) AS agreement,
  round(avg((predicted > 0)::INT) * avg((observed > 0)::INT) + avg((predicted < 0)::INT) * avg((observed < 0)::INT), 6) AS chance,
  round(sqrt(sum((predicted - observed) ^ 2) / sum(observed ^ 2)), 6) AS residual FROM lg GROUP BY dim""")
def vec_sign_agreement(spark: SparkSession, d: str) -> DataFrame:
    """AGG94: share of equal signs, what chance gives, and the relative residual of each column."""
    p, o = F.col("predicted"), F.col("observed")
    share = lambda c: F.avg(c.cast("int"))
    return long_pairs(spark, d).groupBy("dim").agg(
        share(F.signum(p) == F.signum(o)).alias("agreement"),
        (share(p > 0) * share(o > 0) + share(p < 0) * share(o < 0)).alias("chance"),
        F.sqrt(ratio(F.sum((p - o) * (p - o)), F.sum(o * o))).alias("residual"),
    )


@query(f"WITH {NORMS}, m AS (SELECT quantile_cont(na, 0.5) AS g FROM nr WHERE grp < 5 AND na > 0) SELECT id, round(na / g, 6) AS speed FROM nr, m")
def vec_gauge(spark: SparkSession, d: str) -> DataFrame:
    """AGG100, AGG101: lengths in units of the median length of the fitted rows (labels below 5)."""
    x = norms(spark, d)
    g = profiles.exact_quantiles(x.filter("grp < 5 and na > 0").select(F.col("na").alias("value")), [], "value", (0.5,)).select(F.col("quantile").alias("g"))
    return x.crossJoin(F.broadcast(g)).select("id", (F.col("na") / F.col("g")).alias("speed"))  # g: one row


@query(f"WITH {NORMS}, m AS (SELECT greatest(quantile_cont(na, 0.95), 1e-12) AS cap FROM nr WHERE grp < 5 AND na > 0) SELECT id, round(CASE WHEN na = 0 OR cap IS NULL THEN 0 WHEN na > cap THEN (cap / na) ^ 2 ELSE 1 END, 6) AS reliability FROM nr, m")
def vec_speed_reliability(spark: SparkSession, d: str) -> DataFrame:
    """AGG103: (cap / length) squared beyond the 95th percentile of the fitted rows that have a length, else 1; 0 for rows without."""
    return reliability(norms(spark, d))


def reliability(x: DataFrame) -> DataFrame:
    """(id, reliability) of (id, grp, na); fitted rows are those of a group below 5."""
    fitted = x.filter("grp < 5 and na > 0").select(F.col("na").alias("value"))
    cap = profiles.exact_quantiles(fitted, [], "value", (0.95,)).agg(F.greatest(F.max("quantile"), F.lit(1e-12)).alias("cap"), F.count("*").alias("fits"))
    value = F.when((F.col("na") == 0) | (F.col("fits") == 0), 0.0).when(F.col("na") > F.col("cap"), (F.col("cap") / F.col("na")) ** 2).otherwise(1.0)
    return x.crossJoin(F.broadcast(cap)).select("id", value.alias("reliability"))  # cap: one row


#: Rows of a group whose pairs ``vec_mean_direction_share`` compares: the first by a hash of the id.
PROBE = 2000


@query(f"""WITH {PAIR}, lg AS (SELECT id, grp, unnest(range(0, 64)) AS dim, unnest(a) AS x FROM pr), m AS (SELECT grp, dim, sum((x - mean) ^ 2) AS c, sum(x * x) AS t FROM (SELECT *, avg(x) OVER (PARTITION BY grp, dim) AS mean FROM lg) GROUP BY ALL),
en AS (SELECT grp, 1 - sum(c) / sum(t) AS share FROM m GROUP BY grp), p AS (SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY grp ORDER BY md5(id::VARCHAR), id) <= 2000),
c AS (SELECT x.grp, quantile_cont(list_cosine_similarity(x.a, y.a), 0.5) AS median FROM p x JOIN p y ON x.grp = y.grp AND x.id <> y.id GROUP BY x.grp)
SELECT grp, round(share, 6) + 0.0 AS energy_share, round(median, 6) + 0.0 AS pairwise_cosine FROM en JOIN c USING (grp)""")
def vec_mean_direction_share(spark: SparkSession, d: str) -> DataFrame:
    """AGG102: the share of the raw vectors' energy that lies in their mean, and the median cosine of the pairs of a
    bounded probe; groups of one row are left out."""
    x = both(spark, d)
    lg = x.select("grp", F.posexplode("a").alias("dim", "x"))
    sums = lg.groupBy("grp", "dim").agg((F.var_pop("x") * F.count("x")).alias("c"), F.sum(F.col("x") * F.col("x")).alias("t"))
    energy = sums.groupBy("grp").agg((1 - F.sum("c") / F.sum("t")).alias("energy_share"))
    order = W.partitionBy("grp").orderBy(F.md5(F.col("id").cast("string")), "id")
    probe = x.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= PROBE)

    def median(g: pd.DataFrame) -> pd.DataFrame:  # at most PROBE rows
        v = np.stack(g.a.to_numpy()).astype(float)
        v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        c = (v @ v.T)[~np.eye(len(v), dtype=bool)]
        return pd.DataFrame({"grp": g.grp[:1], "pairwise_cosine": [float(np.median(c)) if len(c) else None]})

    pairwise = probe.select("grp", "a").groupBy("grp").applyInPandas(median, "grp int, pairwise_cosine double")
    return energy.join(pairwise.filter("pairwise_cosine is not null"), "grp")


@query(f"WITH {LONG}, s AS (SELECT dim, stddev_pop(predicted) AS s, max(predicted) - min(predicted) AS span FROM lg GROUP BY dim) SELECT round(max(s), 6) AS spread, max(s) < 1e-8 AS collapsed, round(avg((span < 0.001)::INT), 6) AS constant_share FROM s")
def vec_collapsed(spark: SparkSession, d: str) -> DataFrame:
    """PF38, VEC4, AGG45: whether all columns are constant, and the share of columns whose range is tiny."""
    s = long_pairs(spark, d).groupBy("dim").agg(F.stddev_pop("predicted").alias("s"), (F.max("predicted") - F.min("predicted")).alias("span"))
    return s.agg(F.max("s").alias("spread"), (F.max("s") < 1e-8).alias("collapsed"), F.avg((F.col("span") < 0.001).cast("int")).alias("constant_share"))


GRAM = """, c AS (SELECT x.dim AS i, y.dim AS j, corr(x.predicted, y.predicted) AS a, corr(x.observed, y.observed) AS b FROM lg x JOIN lg y ON x.id = y.id AND x.dim < y.dim GROUP BY ALL)"""


@query(f"WITH {LONG}{GRAM} SELECT round(avg(abs(a - b)), 6) AS gap FROM c")
def vec_correlation_gap(spark: SparkSession, d: str) -> DataFrame:
    """AGG105: mean absolute difference of the column correlations of the two fields."""
    x = both(spark, d)
    a, b = (vectors.correlations(x.select(F.col(k).alias("vec"))).withColumnRenamed("corr", k) for k in "ab")
    return a.join(b, ["i", "j"]).agg(F.avg(F.abs(F.col("a") - F.col("b"))).alias("gap"))


BACK = f"""WITH {PAIR}, q AS (SELECT * FROM pr WHERE id % 20 = 0),
s AS (SELECT q.id, q.grp, count_if(list_distance(q.a, c.b) < list_distance(q.a, q.b) - 1e-12) AS f, count_if(list_distance(q.b, c.a) < list_distance(q.a, q.b) - 1e-12) AS g, count(*) AS n FROM q JOIN pr c ON """


def two_ways(spark: SparkSession, d: str, within: bool) -> DataFrame:
    """(id, grp, n, score): mean of both directions of the share of rows closer than the partner."""
    p = pairs(spark, d) if within else pairs(spark, d).withColumn("grp", F.lit(0))
    turned = p.select("id", F.col("b").alias("a"), F.col("a").alias("b"), "grp")
    f, g = (vectors.foscttm(x.filter("id % 20 = 0"), x) for x in (p, turned))
    return f.join(g.select("id", F.col("closer").alias("back")), "id").select("id", "grp", "n", ((F.col("closer") + F.col("back")) / (2.0 * F.when(F.col("n") > 1, F.col("n") - 1))).alias("score"))


@query(BACK + "true GROUP BY ALL) SELECT id, round((f + g) / (2.0 * (n - 1)), 6) AS score FROM s WHERE n > 1 UNION ALL SELECT id, NULL FROM s WHERE n <= 1")
def vec_foscttm_both_ways(spark: SparkSession, d: str) -> DataFrame:
    """VEC3: mean of both directions for each row."""
    return two_ways(spark, d, False).select("id", "score")


@query(BACK + "q.grp = c.grp GROUP BY ALL) SELECT grp, count(*) AS n_queries, round(avg((f + g) / (2.0 * (n - 1))), 6) AS score FROM s WHERE n >= 10 GROUP BY grp")
def vec_foscttm_groups(spark: SparkSession, d: str) -> DataFrame:
    """VEC12: both directions inside groups of ten rows or more, mean per group."""
    return two_ways(spark, d, True).filter("n >= 10").groupBy("grp").agg(F.count("*").alias("n_queries"), F.avg("score").alias("score"))


@query(f"{fos('true')} SELECT " + ", ".join(f"round(avg((closer < greatest(1, round_even({p / 100} * n, 0)))::INT), 6) AS top_{p}" for p in (1, 5, 10)) + " FROM s")
def vec_fosknn_report(spark: SparkSession, d: str) -> DataFrame:
    """VEC6: share of rows whose partner is among the nearest 1, 5 and 10 %."""
    p = pairs(spark, d).withColumn("grp", F.lit(0))
    s = vectors.foscttm(p.filter("id % 20 = 0"), p)
    hit = lambda x: F.avg((F.col("closer") < F.greatest(F.lit(1.0), F.rint(F.lit(x / 100) * F.col("n")))).cast("int")).alias(f"top_{x}")
    return s.agg(*map(hit, (1, 5, 10)))


FIRST = f"""WITH {PAIR}, q AS (SELECT * FROM pr WHERE id % 20 = 0), dd AS (SELECT q.id, q.grp, c.id AS partner, c.grp AS pg, round(list_distance(q.a, c.b), 12) AS dist FROM q, pr c),
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, partner) AS r FROM dd) WHERE r <= 10)"""


def partners(spark: SparkSession, d: str, k: int) -> DataFrame:
    p = pairs(spark, d)
    return vectors.nearest(p.filter("id % 20 = 0").select("id", F.col("a").alias("vec")), p.select("id", F.col("b").alias("vec")), k, include_self=True)


@query(FIRST + """, t AS (SELECT count(DISTINCT id) AS n FROM nn), c AS (SELECT partner, count(*) AS m FROM nn WHERE r = 1 GROUP BY partner)
SELECT round((SELECT count(*) FROM nn WHERE r <= 1 AND id = partner) / n, 6) AS top_1, round((SELECT count(*) FROM nn WHERE r <= 5 AND id = partner) / n, 6) AS top_5, round((SELECT count(*) FROM nn WHERE id = partner) / n, 6) AS top_10,
  round((SELECT count(*) FROM c) / n, 6) AS partner_diversity, round((SELECT max(m) FROM c) / n, 6) AS top_partner_share FROM t""")
def vec_retrieval_report(spark: SparkSession, d: str) -> DataFrame:
    """VEC7, VEC14: partners among the nearest 1, 5 and 10; how many partners come first for someone, and the most frequent one's share."""
    near_ = partners(spark, d, 10)
    hits = near_.groupBy("id").agg(*(F.max(((F.col("rank") <= k) & (F.col("id") == F.col("neighbour"))).cast("int")).alias(f"h{k}") for k in (1, 5, 10)))
    one = hits.agg(F.count("*").alias("n"), *(F.avg(f"h{k}").alias(f"top_{k}") for k in (1, 5, 10)))
    first = near_.filter("rank = 1").groupBy("neighbour").count().agg(F.count("*").alias("distinct"), F.max("count").alias("most"))
    return one.crossJoin(first).select("top_1", "top_5", "top_10", (F.col("distinct") / F.col("n")).alias("partner_diversity"), (F.col("most") / F.col("n")).alias("top_partner_share"))


@query(FIRST + " SELECT grp, count(*) AS n, round(avg((grp = pg)::INT), 6) AS accuracy FROM nn WHERE r = 1 GROUP BY grp")
def vec_match_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """VEC8: share of rows whose nearest partner has their own label."""
    g = pairs(spark, d).select("id", "grp")
    x = partners(spark, d, 1).join(g, "id").join(g.select(F.col("id").alias("neighbour"), F.col("grp").alias("pg")), "neighbour")
    return x.groupBy("grp").agg(F.count("*").alias("n"), F.avg((F.col("grp") == F.col("pg")).cast("int")).alias("accuracy"))


SELF = NEAR.replace("q.id <> c.id", "true")


@query(f"{SELF}, vt AS (SELECT id, (neighbour < (SELECT h FROM h))::INT AS m, count(*) AS n FROM nn GROUP BY ALL), s AS (SELECT id, sum(n) * sum(n) / sum(n * n) AS v FROM vt GROUP BY id) SELECT count(*) AS n, round(avg(v), 6) AS mixing FROM s")
def vec_mixing_mean(spark: SparkSession, d: str) -> DataFrame:
    """VEC10: mean over rows of 1 / sum of squared modality shares among the nearest, the row itself included."""
    x = rows(spark, d)
    half = x.count() // 2
    n = vectors.nearest(x.filter("id % 20 = 0"), x, 10, include_self=True)
    modality = x.select("id", (F.col("id") < half).cast("int").alias("label"))
    return vectors.inverse_simpson(n, modality).agg(F.count("*").alias("n"), F.avg("ilisi").alias("mixing"))


@query(f"""WITH RECURSIVE {HALF}, big AS (SELECT label FROM e GROUP BY label HAVING count(*) > 10), dd AS (SELECT q.id, c.id AS neighbour, q.label, round(list_distance(q.v, c.v), 12) AS dist FROM e q JOIN big USING (label) JOIN e c ON q.label = c.label AND q.id <> c.id),
ed AS (SELECT id AS src, neighbour AS dst FROM dd QUALIFY row_number() OVER (PARTITION BY id ORDER BY dist, neighbour) <= 10), b AS (SELECT src, dst FROM ed UNION SELECT dst, src FROM ed),
r(node, comp) AS (SELECT src, src FROM b UNION SELECT b.dst, r.comp FROM r JOIN b ON r.node = b.src), m AS (SELECT node, min(comp) AS comp FROM r GROUP BY node),
c AS (SELECT label, comp, count(*) AS n FROM m JOIN e ON e.id = m.node GROUP BY ALL) SELECT label, sum(n)::BIGINT AS nodes, round(max(n) / sum(n), 6) AS largest_share FROM c GROUP BY label""")
def vec_label_connectivity(spark: SparkSession, d: str) -> DataFrame:
    """VEC11: for each label with more than ten rows, the share of its largest component in the graph of all its rows'
    ten nearest others inside the label. All rows ask; a label's pairs of tiles are dealt over tasks."""
    x = rows(spark, d).select("id", "vec", F.col("label").alias("lst"))
    big = x.groupBy("lst").count().filter("count > 10").select("lst")
    x = x.join(big, "lst").select("id", "vec", "lst")
    near_ = index.nearest_in_lists(x, x, 10)
    comp = graphs.components(near_.select(F.col("id").alias("src"), F.col("neighbour").alias("dst")))
    n = comp.join(x.select(F.col("id").alias("node"), F.col("lst").alias("label")), "node").groupBy("label", "component").count()
    return n.groupBy("label").agg(F.sum("count").alias("nodes"), (F.max("count") / F.sum("count")).alias("largest_share"))


@query("""WITH x AS (SELECT label AS a, CASE WHEN embedding[1] > 0 THEN 1 ELSE 0 END + CASE WHEN embedding[2] > 0 THEN 2 ELSE 0 END AS b FROM embeddings), c AS (SELECT a, b, count(*)::DOUBLE AS n FROM x GROUP BY ALL), t AS (SELECT sum(n) AS t FROM c),
ca AS (SELECT a, sum(n) AS na FROM c GROUP BY a), cb AS (SELECT b, sum(n) AS nb FROM c GROUP BY b), mi AS (SELECT sum(n / t * ln(n * t / (na * nb))) AS mi FROM c JOIN ca USING (a) JOIN cb USING (b), t),
h AS (SELECT (SELECT -sum(na / t * ln(na / t)) FROM ca, t) AS ha, (SELECT -sum(nb / t * ln(nb / t)) FROM cb, t) AS hb) SELECT round(mi, 6) + 0.0 AS mutual_information, round(2 * mi / (ha + hb), 6) + 0.0 AS nmi FROM mi, h""")
def vec_nmi(spark: SparkSession, d: str) -> DataFrame:
    """VEC15: normalised mutual information (arithmetic mean of entropies) of labels and clusters."""
    x = rows(spark, d).select(F.col("label").alias("a"), ((F.col("vec")[0] > 0).cast("int") + 2 * (F.col("vec")[1] > 0).cast("int")).alias("b"))
    return vectors.mutual_information(x, "a", "b")


@query(f"""WITH {HALF}, q AS (SELECT * FROM e WHERE id % 20 = 0), m AS (SELECT q.id, q.label, c.label AS cl, sum(list_distance(q.v, c.v)) AS s, count(*) AS n FROM q, e c GROUP BY ALL),
o AS (SELECT id, label, CASE WHEN n > 1 THEN s / (n - 1) END AS own FROM m WHERE label = cl), x AS (SELECT id, min(s / n) AS other FROM m WHERE label <> cl GROUP BY id)
SELECT label, count(*) AS n, round(avg(CASE WHEN own IS NULL THEN 0 ELSE (other - own) / greatest(other, own) END), 6) + 0.0 AS silhouette FROM o JOIN x USING (id) GROUP BY label""")
def vec_silhouette(spark: SparkSession, d: str) -> DataFrame:
    """VEC15: silhouette of the query rows against all rows, mean per label; rows alone in their label count 0."""
    return vectors.silhouette(rows(spark, d).filter("id % 20 = 0"), rows(spark, d)).groupBy("label").agg(F.count("*").alias("n"), F.avg("silhouette").alias("silhouette"))


@query(f"{NEAR}, lg AS (SELECT id, unnest(range(0, 64)) AS dim, unnest(v) AS x FROM e) SELECT nn.id, dim, round(avg(x), 6) + 0.0 AS mean FROM nn JOIN lg ON lg.id = nn.neighbour GROUP BY nn.id, dim")
def vec_neighbour_mean(spark: SparkSession, d: str) -> DataFrame:
    """VEC16, VEC18, VEC20: mean field of the ten nearest others, by column."""
    lg = rows(spark, d).select(F.col("id").alias("neighbour"), F.posexplode("vec").alias("dim", "x"))
    return near(spark, d).select("id", "neighbour").join(lg, "neighbour").groupBy("id", F.col("dim").cast("long").alias("dim")).agg(F.avg(F.col("x").cast("double")).alias("mean"))


#: Vectors less the mean of their column, over all rows of ``{0}`` (id, v).
LESS_MEAN = "SELECT id, list(x - mean ORDER BY dim) AS v FROM (SELECT id, dim, x, avg(x) OVER (PARTITION BY dim) AS mean FROM (SELECT id, unnest(range(0, 64)) AS dim, unnest(v) AS x FROM {0})) GROUP BY id"
MEANS = "SELECT id, list(x ORDER BY dim) AS v FROM (SELECT id, dim, avg(x) AS x FROM (SELECT o.id, unnest(range(0, 64)) AS dim, unnest(e.v) AS x FROM {0} o JOIN e ON e.id = o.neighbour) GROUP BY ALL) GROUP BY id"


@query(f"""{NEAR}, l AS ({MEANS.format('nn')}), n AS (SELECT count(*) AS n FROM e), far AS (SELECT id, floor(('0x' || substr(md5('31:' || id || ':' || k), 1, 13))::BIGINT / 4503599627370496.0 * n)::BIGINT AS neighbour FROM q, n, range(1, 11) AS g(k)), f AS ({MEANS.format('far')}),
ce AS ({LESS_MEAN.format('e')}), cl AS ({LESS_MEAN.format('l')}), cf AS ({LESS_MEAN.format('f')}) SELECT (SELECT round(quantile_cont(list_cosine_similarity(e.v, l.v), 0.5), 6) + 0.0 FROM e JOIN l USING (id)) AS neighbour_cosine,
(SELECT round(quantile_cont(list_cosine_similarity(ce.v, cl.v), 0.5), 6) + 0.0 FROM ce JOIN cl USING (id)) AS centred_cosine, (SELECT round(quantile_cont(list_cosine_similarity(ce.v, cf.v), 0.5), 6) + 0.0 FROM ce JOIN cf USING (id)) AS random_cosine""")
def vec_neighbour_coherence(spark: SparkSession, d: str) -> DataFrame:
    """VEC17: medians, over the query rows, of the cosine of a row with the mean of its ten nearest others: as it is, with
    both sides less their means, and the latter with ten rows drawn at random instead. Ids run from 0 without gaps."""
    v = rows(spark, d).select("id", doubles("vec").alias("v"))
    n = v.agg(F.count("*").alias("n"))
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("31"), "id", "k")), 1, 13), 16, 10).cast("long") / F.lit(2.0**52)
    far = v.filter("id % 20 = 0").select("id", F.explode(F.sequence(F.lit(1), F.lit(10))).alias("k")).crossJoin(F.broadcast(n)).select("id", F.floor(draw * F.col("n")).alias("neighbour"))  # n: one row
    near_mean, far_mean = (write_table(mean_of(x, v), "coherence") for x in (near(spark, d), far))  # each is read several times
    plain = v.join(near_mean.withColumnRenamed("v", "w"), "id")
    centred_ = [less_mean(v).join(less_mean(m).withColumnRenamed("v", "w"), "id") for m in (near_mean, far_mean)]
    out = None
    for x, name in ((plain, "neighbour_cosine"), (centred_[0], "centred_cosine"), (centred_[1], "random_cosine")):
        value = write_table(x.select(cosine(F.col("v"), F.col("w")).alias("value")), "coherence")
        c = profiles.exact_quantiles(value, [], "value", (0.5,)).select(F.col("quantile").alias(name))
        out = c if out is None else out.crossJoin(c)  # one row each
    return out


def packed_up(lg: DataFrame) -> DataFrame:
    """(id, v) of (id, dim, x)."""
    return lg.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "x"))), lambda s: s.x).alias("v"))


def mean_of(links: DataFrame, v: DataFrame) -> DataFrame:
    """(id, v): mean vector of each row's neighbours."""
    lg = links.select("id", "neighbour").join(v.select(F.col("id").alias("neighbour"), F.posexplode("v").alias("dim", "x")), "neighbour")
    return packed_up(lg.groupBy("id", "dim").agg(F.avg("x").alias("x")))


def less_mean(v: DataFrame) -> DataFrame:
    """(id, v): vectors less the mean vector of all rows."""
    lg = v.select("id", F.posexplode("v").alias("dim", "x"))
    m = lg.groupBy("dim").agg(F.avg("x").alias("mean"))
    mean = m.agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "mean"))), lambda s: s.mean).alias("mean"))  # one row
    return v.crossJoin(F.broadcast(mean)).select("id", F.zip_with("v", "mean", lambda a, b: a - b).alias("v"))


@query(f"{NEAR}, w AS (SELECT nn.id, e.label, 1 / greatest(dist, 1e-8) AS w FROM nn JOIN e ON e.id = nn.neighbour) SELECT id, round(sum(w * label) / sum(w), 6) AS value FROM w GROUP BY id")
def vec_interpolated(spark: SparkSession, d: str) -> DataFrame:
    """Inverse-distance weighted mean of the neighbours' values."""
    x = near(spark, d).join(rows(spark, d).select(F.col("id").alias("neighbour"), "label"), "neighbour").withColumn("w", 1 / F.greatest("distance", F.lit(1e-8)))
    return x.groupBy("id").agg((F.sum(F.col("w") * F.col("label")) / F.sum("w")).alias("value"))


#: Random permutations of the pairs, {0} - 1 draws with seed {1}.
PERMUTED = "pm AS (SELECT x.b, x.id, y.id AS other FROM (SELECT k AS b, id, row_number() OVER (PARTITION BY k ORDER BY id) AS r FROM pr, range(1, {0}) AS g(k)) x JOIN (SELECT k AS b, id, row_number() OVER (PARTITION BY k ORDER BY md5('{1}:' || k || ':' || id), id) AS r FROM pr, range(1, {0}) AS g(k)) y ON x.b = y.b AND x.r = y.r)"


@query(f"WITH {PAIR}, {PERMUTED.format(2, 32)}, p2 AS (SELECT x.id, x.a, y.b, x.grp FROM pr x JOIN pm USING (id) JOIN pr y ON y.id = pm.other), q AS (SELECT * FROM p2 WHERE id % 20 = 0), s AS (SELECT q.id, count_if(list_distance(q.a, c.b) < list_distance(q.a, q.b) - 1e-12) AS closer, count(*) AS n FROM q, p2 c GROUP BY q.id) SELECT round(avg(closer / (n - 1)), 6) AS floor FROM s")
def vec_pairing_floor(spark: SparkSession, d: str) -> DataFrame:
    """BS8: the measure of ``vec_foscttm`` under a random pairing."""
    p = pairs(spark, d)
    partners = resampling.permuted(p, "id", 1, 32).select("id", "other").join(p.select(F.col("id").alias("other"), "b"), "other").select("id", "b")
    x = p.select("id", "a").join(partners, "id").withColumn("grp", F.lit(0))
    return vectors.foscttm(x.filter("id % 20 = 0"), x).agg(F.avg("foscttm").alias("floor"))


@query(f"""WITH {PAIR}, {PERMUTED.format(21, 33)}, ca AS ({LESS_MEAN.format('(SELECT id, a AS v FROM pr)')}), cb AS ({LESS_MEAN.format('(SELECT id, b AS v FROM pr)')}),
c AS (SELECT pm.b, quantile_cont(list_cosine_similarity(ca.v, cb.v), 0.5) AS c FROM pm JOIN ca USING (id) JOIN cb ON cb.id = pm.other GROUP BY pm.b) SELECT count(*) AS draws, round(quantile_cont(c, 0.5), 6) + 0.0 AS null_median, round(quantile_cont(c, 0.95), 6) + 0.0 AS null_p95 FROM c""")
def vec_cosine_null(spark: SparkSession, d: str) -> DataFrame:
    """BS9: median and 95th percentile, over 20 random pairings, of the median cosine with each side less its own mean."""
    x = both(spark, d)
    a, b = less_mean(x.select("id", F.col("a").alias("v"))), less_mean(x.select("id", F.col("b").alias("v")))
    met = resampling.permuted(x, "id", 20, 33).withColumnRenamed("b", "draw").join(a, "id").join(b.select(F.col("id").alias("other"), F.col("v").alias("w")), "other")
    c = profiles.exact_quantiles(met.select("draw", cosine(F.col("v"), F.col("w")).alias("value")), ["draw"], "value", (0.5,))
    return c.agg(F.count("*").alias("draws"), F.percentile("quantile", 0.5).alias("null_median"), F.percentile("quantile", 0.95).alias("null_p95"))  # 20 rows


@query(f"""{NEAR}, w AS (SELECT nn.id, (y.label - x.label)::DOUBLE AS dt, unnest(range(0, 64)) AS dim, unnest(y.v) - unnest(x.v) AS dx FROM nn JOIN e x ON x.id = nn.id JOIN e y ON y.id = nn.neighbour WHERE y.label > x.label)
SELECT id, dim, count(*) AS n, round(sum(dt * dx) / sum(dt * dt), 6) + 0.0 AS slope, round(avg(dx / dt), 6) + 0.0 AS quotient FROM w GROUP BY id, dim""")
def vec_forward_difference(spark: SparkSession, d: str) -> DataFrame:
    """Over neighbours of larger time (label), least-squares slope and mean difference quotient of every component."""
    v = rows(spark, d).select("id", "label", doubles("vec").alias("v"))
    j = near(spark, d).select("id", "neighbour").join(v, "id").join(v.select(F.col("id").alias("neighbour"), F.col("label").alias("l2"), F.col("v").alias("w")), "neighbour").filter("l2 > label")
    j = j.select("id", (F.col("l2") - F.col("label")).cast("double").alias("dt"), F.posexplode(F.zip_with("w", "v", lambda a, b: a - b)).alias("dim", "dx"))
    return j.groupBy("id", F.col("dim").cast("long").alias("dim")).agg(F.count("*").alias("n"), (F.sum(F.col("dt") * F.col("dx")) / F.sum(F.col("dt") * F.col("dt"))).alias("slope"), F.avg(F.col("dx") / F.col("dt")).alias("quotient"))


LABEL_LINKS = """big AS (SELECT label FROM e GROUP BY label HAVING count(*) > 10), dd AS (SELECT q.id, c.id AS neighbour, round(list_distance(q.v, c.v), 12) AS dist FROM e q JOIN big USING (label) JOIN e c ON q.label = c.label AND q.id <> c.id),
ed AS (SELECT id AS src, neighbour AS dst, dist FROM dd QUALIFY row_number() OVER (PARTITION BY id ORDER BY dist, neighbour) <= 5), b AS (SELECT src, dst FROM ed UNION SELECT dst, src FROM ed)"""


@query(f"""WITH RECURSIVE {HALF}, {LABEL_LINKS}, r(source, node, h) AS (SELECT DISTINCT src, src, 0 FROM b WHERE src % 100 = 0 UNION SELECT r.source, b.dst, h + 1 FROM r JOIN b ON b.src = r.node WHERE h < 40)
SELECT source, node, min(h)::DOUBLE AS distance FROM r GROUP BY source, node""")
def graph_geodesics(spark: SparkSession, d: str) -> DataFrame:
    """NUM18: hops from every hundredth row to all rows of its neighbour graph (five nearest others of the same label)."""
    x = rows(spark, d).select("id", "vec", F.col("label").alias("lst"))
    x = x.join(x.groupBy("lst").count().filter("count > 10").select("lst"), "lst").select("id", "vec", "lst")
    e = index.nearest_in_lists(x, x, 5).select(F.col("id").alias("src"), F.col("neighbour").alias("dst"))
    return graphs.geodesics(e, x.filter("id % 100 = 0").select(F.col("id").alias("source"), "lst"), within="lst")


@query()
def graph_pseudotime(spark: SparkSession, d: str) -> DataFrame:
    """NUM8: diffusion pseudotime from row 0 on the graph of all rows' fifteen nearest others, found by the calibrated index."""
    return diffusion.pseudotime(index.graph(rows(spark, d).select("id", "vec"), 15), 0, k=4, tolerance=1e-6)


@query()
def index_recall(spark: SparkSession, d: str) -> DataFrame:
    """Lists, probes and measured recall of the neighbour index over all rows."""
    c, probes, got = index.calibrated(rows(spark, d).select("id", "vec"), 10)
    return spark.createDataFrame([(len(c), probes, float(got), got >= 0.9)], "lists int, probes int, recall double, reached boolean")
