"""Embedding queries: modality 1 = first half of the vectors, partner = vector id plus half; label = group.
Queries are all rows whose id is divisible by 20, against all rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import pearson, ratio
from ..operators import graphs, profiles, transport, vectors
from ..sources.shared import write_table
from ..sources.tables import table
from .registry import query

HALF = "h AS (SELECT count(*) // 2 AS h FROM embeddings), e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings)"
PAIR = HALF + ", pr AS (SELECT a.id, a.v AS a, b.v AS b, a.label AS grp FROM e a JOIN h ON a.id < h JOIN e b ON b.id = a.id + h)"
DIST = "list_distance({0}, {1})"


def rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """(id, a, b, grp): a row of the first half with its partner's vector. Ids run from 0 without gaps."""
    x = rows(spark, d)
    half = x.count() // 2
    a = x.filter(F.col("id") < half).select("id", F.col("vec").alias("a"), F.col("label").alias("grp"))
    b = x.filter((F.col("id") >= half) & (F.col("id") < 2 * half)).select((F.col("id") - half).alias("id"), F.col("vec").alias("b"))
    return a.join(b, "id")


def fos(within: str) -> str:
    return f"WITH {PAIR}, q AS (SELECT * FROM pr WHERE id % 20 = 0), s AS (SELECT q.id, q.grp, count_if(list_distance(q.a, c.b) < list_distance(q.a, q.b) - 1e-12)::BIGINT AS closer, count(*) AS n FROM q JOIN pr c ON {within} GROUP BY q.id, q.grp)"


@query(f"{fos('true')} SELECT id, closer, round(closer / (n - 1), 6) AS foscttm FROM s WHERE n > 1 UNION ALL SELECT id, closer, NULL FROM s WHERE n <= 1")
def vec_foscttm(spark: SparkSession, d: str) -> DataFrame:
    p = pairs(spark, d).withColumn("grp", F.lit(0))
    return vectors.foscttm(p.filter("id % 20 = 0"), p).select("id", "closer", "foscttm")


@query(f"{fos('q.grp = c.grp')} SELECT id, grp, closer, n, CASE WHEN n > 1 THEN round(closer / (n - 1), 6) END AS foscttm FROM s")
def vec_foscttm_within(spark: SparkSession, d: str) -> DataFrame:
    p = pairs(spark, d)
    return vectors.foscttm(p.filter("id % 20 = 0"), p)


@query(f"{fos('true')}, f AS (SELECT unnest([0.01, 0.05, 0.1, 0.25, 0.5]) AS fraction) SELECT fraction::DOUBLE AS fraction, round(avg((closer < greatest(1, round_even(fraction * n, 0)))::INT), 6) AS share FROM s, f GROUP BY fraction")
def vec_match_rank_curve(spark: SparkSession, d: str) -> DataFrame:
    p = pairs(spark, d).withColumn("grp", F.lit(0))
    s = vectors.foscttm(p.filter("id % 20 = 0"), p)
    f = s.withColumn("fraction", F.explode(F.array(*map(F.lit, (0.01, 0.05, 0.1, 0.25, 0.5)))))
    return f.groupBy("fraction").agg(F.avg((F.col("closer") < F.greatest(F.lit(1.0), F.rint(F.col("fraction") * F.col("n")))).cast("int")).alias("share"))


NEAR = f"WITH {HALF}, q AS (SELECT * FROM e WHERE id % 20 = 0), dd AS (SELECT q.id, c.id AS neighbour, c.label AS nl, round(list_distance(q.v, c.v), 12) AS dist FROM q JOIN e c ON q.id <> c.id), nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, neighbour) AS rank FROM dd) WHERE rank <= 10)"


def near(spark: SparkSession, d: str) -> DataFrame:
    x = rows(spark, d)
    return vectors.nearest(x.filter("id % 20 = 0"), x, 10)


@query(f"{NEAR} SELECT id, neighbour, rank::INT AS rank, round(dist, 6) AS distance FROM nn")
def vec_topk_retrieval(spark: SparkSession, d: str) -> DataFrame:
    return near(spark, d)


@query(f"{NEAR}, vt AS (SELECT id, nl, count(*) AS n FROM nn GROUP BY id, nl) SELECT id, nl AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, nl) AS r FROM vt) WHERE r = 1")
def vec_knn_label_transfer(spark: SparkSession, d: str) -> DataFrame:
    return vectors.label_vote(near(spark, d), rows(spark, d))


@query(f"{NEAR}, vt AS (SELECT id, nl, count(*) AS n FROM nn GROUP BY id, nl) SELECT id, round(sum(n) * sum(n) / sum(n * n), 6) AS ilisi FROM vt GROUP BY id")
def vec_ilisi(spark: SparkSession, d: str) -> DataFrame:
    return vectors.inverse_simpson(near(spark, d), rows(spark, d))


@query(f"WITH {HALF}, q AS (SELECT * FROM e WHERE id % 20 = 0), dd AS (SELECT q.id, c.id AS neighbour, c.label AS nl, round(list_distance(q.v, c.v), 12) AS dist FROM q JOIN e c ON q.id <> c.id AND c.label < 5), nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, neighbour) AS r FROM dd) WHERE r <= 10) SELECT id, count(*) AS n, round(avg(nl), 6) AS mean FROM nn GROUP BY id")
def vec_knn_allowed_mean(spark: SparkSession, d: str) -> DataFrame:
    x = rows(spark, d)
    n = vectors.nearest(x.filter("id % 20 = 0"), x.filter("label < 5"), 10)
    return n.join(x.select(F.col("id").alias("neighbour"), "label"), "neighbour").groupBy("id").agg(F.count("*").alias("n"), F.avg("label").alias("mean"))


LONG = PAIR + ", lg AS (SELECT id, unnest(range(0, 64)) AS dim, unnest(a) AS predicted, unnest(b) AS observed FROM pr)"


def long_pairs(spark: SparkSession, d: str) -> DataFrame:
    z = F.posexplode(F.arrays_zip("a", "b")).alias("dim", "z")
    return pairs(spark, d).select("id", z).select("id", F.col("dim").cast("long").alias("dim"), F.col("z.a").cast("double").alias("predicted"), F.col("z.b").cast("double").alias("observed"))


@query(f"WITH {LONG} SELECT dim, round(covar_pop(predicted, observed) / (stddev_pop(predicted) * stddev_pop(observed)), 6) + 0.0 AS pearson, round(sqrt(avg((predicted - observed) ^ 2)) / stddev_pop(observed), 6) AS nrmse FROM lg GROUP BY dim")
def vec_column_stats(spark: SparkSession, d: str) -> DataFrame:
    err = F.col("predicted") - F.col("observed")
    return long_pairs(spark, d).groupBy("dim").agg(pearson("predicted", "observed").alias("pearson"), ratio(F.sqrt(F.avg(err * err)), F.stddev_pop("observed")).alias("nrmse"))


@query(f"""WITH {LONG}, m AS (SELECT dim, avg(predicted) AS mp, avg(observed) AS mo FROM lg GROUP BY dim)
SELECT id, round(coalesce(sum((predicted - mp) * (observed - mo)) / nullif(sqrt(sum((predicted - mp) ^ 2) * sum((observed - mo) ^ 2)), 0), 0), 6) + 0.0 AS cosine FROM lg JOIN m USING (dim) GROUP BY id""")
def vec_row_cosine_centred(spark: SparkSession, d: str) -> DataFrame:
    """AGG92: cosine of each row's two vectors, each side less its own mean; 0 where one has no length."""
    x = long_pairs(spark, d)
    m = x.groupBy("dim").agg(F.avg("predicted").alias("mp"), F.avg("observed").alias("mo"))
    c = x.join(m, "dim").select("id", (F.col("predicted") - F.col("mp")).alias("p"), (F.col("observed") - F.col("mo")).alias("o"))
    return c.groupBy("id").agg(F.coalesce(ratio(F.sum(F.col("p") * F.col("o")), F.sqrt(F.sum(F.col("p") ** 2) * F.sum(F.col("o") ** 2))), F.lit(0.0)).alias("cosine"))


@query("WITH x AS (SELECT label AS a, CASE WHEN embedding[1] > 0 THEN 1 ELSE 0 END + CASE WHEN embedding[2] > 0 THEN 2 ELSE 0 END AS b FROM embeddings), n AS (SELECT a, b, count(*) AS n FROM x GROUP BY ALL), t AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM n) AS s, (SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(n) AS m FROM n GROUP BY a)) AS sa, (SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(n) AS m FROM n GROUP BY b)) AS sb, (SELECT sum(n) FROM n) AS al) SELECT round((s - sa * sb / (al * (al - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (al * (al - 1) / 2)), 6) + 0.0 AS ari FROM t")
def vec_ari(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "embeddings").select(F.col("label").alias("a"), ((F.col("embedding")[0] > 0).cast("int") + 2 * (F.col("embedding")[1] > 0).cast("int")).alias("b"))
    return vectors.adjusted_rand(x, "a", "b")


@query(f"WITH {HALF}, m AS (SELECT (SELECT avg(list_distance(q.v, c.v)) FROM e q, e c WHERE q.label < 5 AND c.label >= 5) AS ab, (SELECT avg(list_distance(q.v, c.v)) FROM e q, e c WHERE q.label < 5 AND c.label < 5) AS aa, (SELECT avg(list_distance(q.v, c.v)) FROM e q, e c WHERE q.label >= 5 AND c.label >= 5) AS bb) SELECT round((2 * ab - aa - bb) / bb, 6) + 0.0 AS energy FROM m")
def vec_energy_distance(spark: SparkSession, d: str) -> DataFrame:
    x = rows(spark, d)
    return vectors.energy_distance(x.filter("label < 5"), x.filter("label >= 5"))


@query()
def graph_components(spark: SparkSession, d: str) -> DataFrame:
    """Components of all supplier-part pairs (no SQL: too slow; tests compare with union-find)."""
    li = table(spark, d, "lineitem")
    return graphs.components(li.select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1000000000000).alias("dst")).distinct())


def halves(spark: SparkSession, d: str) -> DataFrame:
    """(grp, id, side, vec, payload): the first half of all rows against the second inside each label; the payload is the first
    four entries."""
    x = rows(spark, d)
    half = x.count() // 2
    x = x.withColumn("side", F.when(F.col("id") < half, "a").otherwise("b"))
    return x.select(F.col("label").alias("grp"), "id", "side", "vec", F.slice("vec", 1, 4).cast("array<double>").alias("payload"))


@query()
def ot_sinkhorn_rows(spark: SparkSession, d: str) -> DataFrame:
    """NUM1, VEC24: rows of the transport plans inside labels: best partner, its share, mass, entropy and confidence."""
    return transport.rows_of(transport.sinkhorn(halves(spark, d), 0.05, 10)).drop("projected")


@query()
def ot_displacement(spark: SparkSession, d: str) -> DataFrame:
    """NUM4, NUM5: where the plan takes each row, less where it is, over an interval of 7, by component; dynamic rows are the
    upper three quarters of their label by confidence."""
    x = halves(spark, d)
    got = write_table(transport.rows_of(transport.sinkhorn(x, 0.05, 10)), "displacement")
    cut = profiles.exact_quantiles(got.select("grp", F.col("confidence").alias("value")), ["grp"], "value", (0.25,)).select("grp", F.col("quantile").alias("cut"))
    own = x.select(F.col("id").alias("src"), "payload")
    moved = got.join(own, "src").join(cut, "grp").withColumn("v", F.zip_with("projected", "payload", lambda p, o: (p - o) / 7))
    return moved.select("src", "confidence", (F.col("confidence") >= F.col("cut")).alias("dynamic"), F.posexplode("v").alias("component", "velocity"))


@query()
def ot_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """VEC13: ranks of the true partners by transported mass, per label."""
    p = pairs(spark, d)
    side = lambda s, c: p.select("grp", "id", F.lit(s).alias("side"), F.col(c).alias("vec"))
    return transport.retrieval(transport.sinkhorn(side("a", "a").unionByName(side("b", "b")), 0.05, 10))


@query()
def ot_unbalanced(spark: SparkSession, d: str) -> DataFrame:
    """NUM18: the mass that each row keeps where margins are penalised instead of held, against its even share."""
    got = transport.rows_of(transport.sinkhorn(halves(spark, d).drop("payload"), 0.05, 10, penalty=0.5))
    n = got.groupBy("grp").agg(F.count("*").alias("n"))
    return got.join(n, "grp").select("grp", "src", "dst", "mass", (F.col("mass") * F.col("n")).alias("kept"))


@query()
def ot_divergence(spark: SparkSession, d: str) -> DataFrame:
    """NUM20: debiased entropic divergence of the halves of each label."""
    return transport.divergence(halves(spark, d).drop("payload"), 0.5, 5)


BINS = "WITH e AS (SELECT user_id, epoch_us(ts) / 1000000.0 AS t, value FROM events), r AS (SELECT user_id, min(t) AS lo, max(t) AS hi FROM e GROUP BY user_id), b AS (SELECT e.user_id, CASE WHEN hi > lo THEN least(floor((t - lo) / (hi - lo) * 10), 9) ELSE 0 END::INT AS bin, value FROM e JOIN r USING (user_id))"


def bins_of(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", (F.unix_micros("ts") / 1e6).alias("t"), "value")
    r = e.groupBy("user_id").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("t") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 10), F.lit(9))).otherwise(0).cast("int")
    return e.join(r, "user_id").select("user_id", at.alias("bin"), "value").groupBy("user_id", "bin").agg(F.count("*").alias("n"), F.avg("value").alias("centroid"))


@query(f"{BINS} SELECT user_id, bin, count(*) AS n, round(avg(value), 6) AS centroid FROM b GROUP BY user_id, bin")
def traj_binned_centroids(spark: SparkSession, d: str) -> DataFrame:
    return bins_of(spark, d)


@query()
def traj_dtw(spark: SparkSession, d: str) -> DataFrame:
    """Dynamic-time-warping cost of each user's binned trajectory (at most 10 bins) against that of the next user."""
    s = bins_of(spark, d).groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "centroid"))), lambda x: x["centroid"]).alias("seq"))
    both = s.join(s.select((F.col("user_id") - 1).alias("user_id"), F.col("seq").alias("other")), "user_id")

    @F.pandas_udf("double")
    def cost(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([dtw(np.asarray(x), np.asarray(y)) for x, y in zip(a, b, strict=True)])

    return both.select("user_id", cost("seq", "other").alias("dtw"))


def dtw(a: np.ndarray, b: np.ndarray) -> float:
    """Cost of the best monotone alignment with absolute steps, over the sum of lengths."""
    best = np.full((len(a) + 1, len(b) + 1), np.inf)
    best[0, 0] = 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            best[i, j] = abs(a[i - 1] - b[j - 1]) + min(best[i - 1, j], best[i, j - 1], best[i - 1, j - 1])
    return float(best[-1, -1] / (len(a) + len(b)))
