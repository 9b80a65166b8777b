"""Control conditions, permutations, widened links, stopping and integration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import conditions, paths
from ..sources.tables import table
from .fields import PERMUTED, both
from .matrices import X, x_of
from .registry import query
from .vectors import PAIR

FIELD = f"""{PAIR}, {PERMUTED.format(2, 41)}, lg AS (SELECT pr.id, unnest(range(0, 64)) AS dim, unnest(pr.a) AS v, unnest(o.a) AS w, unnest(pr.b) AS c FROM pr JOIN pm USING (id) JOIN pr o ON o.id = pm.other),
nr AS (SELECT id, sqrt(sum(v * v)) AS nv, sqrt(sum((0.6 * v + 0.4 * w) ^ 2)) AS nm FROM lg GROUP BY id), ra AS (SELECT quantile_cont(nv, 0.5) FILTER (nv > 1e-8) / quantile_cont(nm, 0.5) FILTER (nm > 1e-8) AS ratio FROM nr)"""


@query(f"""WITH {FIELD} SELECT 'shuffle' AS condition, id, dim, round(w, 6) + 0.0 AS value FROM lg UNION ALL SELECT 'reverse', id, dim, round(-v, 6) + 0.0 FROM lg UNION ALL SELECT 'zero', id, dim, 0.0 FROM lg
UNION ALL SELECT 'corrupt', id, dim, round((0.6 * v + 0.4 * w) * ratio, 6) + 0.0 FROM lg, ra UNION ALL SELECT 'lag', id, dim, round(c - 0.5 * v, 6) + 0.0 FROM lg""")
def cond_vectors(spark: SparkSession, d: str) -> DataFrame:
    """SPL15 to SPL17, MTH2: a field shuffled, reversed, zeroed, mixed with its shuffle at its own median length, and the state a
    lag before."""
    x = both(spark, d).select("id", F.col("a").alias("v"), F.col("b").alias("c"))
    field = x.select("id", "v")
    parts = {
        "shuffle": conditions.shuffled(field, 41).select("id", F.col("other_v").alias("v")),
        "reverse": field.select("id", F.transform("v", lambda e: -e).alias("v")),
        "zero": field.select("id", F.transform("v", lambda e: e * 0.0).alias("v")),
        "corrupt": conditions.corrupted(field, 0.4, 41),
        "lag": x.select("id", F.zip_with("c", "v", lambda c, e: c - 0.5 * e).alias("v")),
    }
    out = None
    for name, part in parts.items():
        rows = part.select(F.lit(name).alias("condition"), "id", F.posexplode("v").alias("dim", "value")).withColumn("dim", F.col("dim").cast("long"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"WITH {X}, pr AS (SELECT DISTINCT row AS id FROM x), {PERMUTED.format(2, 42)} SELECT pm.id AS row, col, round(value, 6) + 0.0 AS value FROM pm JOIN x ON x.row = pm.other")
def cond_permuted_rows(spark: SparkSession, d: str) -> DataFrame:
    """ARR9: every row that has links gets another such row's."""
    return conditions.permuted_axis(x_of(spark, d), "row", 42)


@query(f"WITH {X}, pr AS (SELECT DISTINCT col AS id FROM x), {PERMUTED.format(2, 43)} SELECT row, pm.id AS col, round(value, 6) + 0.0 AS value FROM pm JOIN x ON x.col = pm.other")
def cond_permuted_columns(spark: SparkSession, d: str) -> DataFrame:
    """ARR10: which column feeds which row is shuffled; rows keep their number of links."""
    return conditions.permuted_axis(x_of(spark, d), "col", 43)


@query(f"""WITH {X}, n AS (SELECT count(DISTINCT row) AS n FROM x), s AS (SELECT col, sum(value) AS s, sum(value * value) AS q FROM x GROUP BY col), dt AS (SELECT a.col, b.col AS linked, sum(a.value * b.value) AS xy FROM x a JOIN x b USING (row) GROUP BY ALL),
c AS (SELECT a.col, b.col AS linked, (coalesce(xy, 0) / n - a.s / n * b.s / n) / sqrt((a.q / n - (a.s / n) ^ 2) * (b.q / n - (b.s / n) ^ 2)) AS r FROM s a CROSS JOIN s b CROSS JOIN n LEFT JOIN dt ON dt.col = a.col AND dt.linked = b.col),
k AS (SELECT col, linked, greatest(r, 0) AS w FROM c QUALIFY row_number() OVER (PARTITION BY col ORDER BY (col <> linked), round(r, 12) DESC, linked) <= 6) SELECT col, linked, round(w / sum(w) OVER (PARTITION BY col), 6) AS weight FROM k WHERE w > 0""")
def map_coaccess(spark: SparkSession, d: str) -> DataFrame:
    """Each brand linked to itself and to the five it is most correlated with over all orders."""
    return conditions.correlated_columns(x_of(spark, d), 5)


@query("""WITH w AS (SELECT user_id, row_number() OVER o AS k, value, min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS least FROM events WINDOW o AS (PARTITION BY user_id ORDER BY event_id)),
i AS (SELECT *, max(CASE WHEN least IS NULL OR value < least THEN k END) OVER (PARTITION BY user_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS last FROM w), s AS (SELECT user_id, min(CASE WHEN k - last >= 3 THEN k END) AS stop FROM i GROUP BY user_id)
SELECT user_id, max(stop) AS stop, max(last) AS best, round(min(value), 6) + 0.0 AS value FROM i JOIN s USING (user_id) WHERE stop IS NULL OR k <= stop GROUP BY user_id""")
def curve_patience(spark: SparkSession, d: str) -> DataFrame:
    """STM3: where each history would have been stopped after three steps without improvement, and its best until then."""
    return paths.stopped(table(spark, d, "events"), "user_id", "event_id", F.col("value"), 3)


PATH = "e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, value AS s, CASE WHEN event_type LIKE 'p%' THEN 0.6 ELSE 0.4 END AS a, CASE WHEN event_id % 2 = 0 THEN 1.2 ELSE 0.8 END AS r FROM events)"


def path_rows(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "events").withColumn("t", F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) * 0.25)
    return x.select("user_id", "t", F.col("value").alias("s"), F.when(F.col("event_type").startswith("p"), 0.6).otherwise(0.4).alias("a"), F.when(F.col("event_id") % 2 == 0, 1.2).otherwise(0.8).alias("r"))


def levels(at_start: str, between: str, at_end: str) -> str:
    """SQL of the integrated levels; ``e`` has the drive at a row (``at_start``, as of the row before; ``at_end``, as of this
    one) and halfway to the next."""
    return f"""p AS (SELECT e.*, 0.0::DOUBLE AS level FROM e WHERE k = 1 UNION ALL
SELECT * EXCLUDE (level, s_0, s_m, s_1, a0, r0, k1, k2, k3), greatest(0.0, level + 0.25 * (k1 + 2 * k2 + 2 * k3 + r * (a * s_1 - 0.3 * (level + 0.25 * k3))) / 6) AS level FROM (
SELECT *, (r0 + r) / 2 * ((a0 + a) / 2 * s_m - 0.3 * (level + 0.125 * k2)) AS k3 FROM (
SELECT *, (r0 + r) / 2 * ((a0 + a) / 2 * s_m - 0.3 * (level + 0.125 * k1)) AS k2 FROM (
SELECT *, r0 * (a0 * s_0 - 0.3 * level) AS k1 FROM (
SELECT e.*, p.level, {at_start} AS s_0, {between} AS s_m, {at_end} AS s_1, p.a AS a0, p.r AS r0 FROM p JOIN e ON e.user_id = p.user_id AND e.k = p.k + 1)))))
SELECT user_id, (k * 0.25)::DOUBLE AS t, round(level, 6) + 0.0 AS level FROM p"""


@query(f"WITH RECURSIVE {PATH}, {levels('p.s', '(p.s + e.s) / 2', 'e.s')}")
def path_integrated(spark: SparkSession, d: str) -> DataFrame:
    """NUM23: levels driven by each user's values, integrated along the events in order."""
    return paths.integrate(path_rows(spark, d), "user_id", "t", "s", "a", "r", 0.3)


#: The drive 0.6 earlier than a row and than halfway to the next, on the grid of quarters: between the third and second, and
#: the second and first row before; the first row's where there are none.
DELAYED = """e AS (SELECT *, 0.4 * coalesce(lag(s, 3) OVER w, f) + 0.6 * coalesce(lag(s, 2) OVER w, f) AS d, 0.9 * coalesce(lag(s, 2) OVER w, f) + 0.1 * coalesce(lag(s, 1) OVER w, f) AS m
FROM (SELECT *, first_value(s) OVER (PARTITION BY user_id ORDER BY k) AS f FROM x) WINDOW w AS (PARTITION BY user_id ORDER BY k))"""


@query(f"WITH RECURSIVE {PATH.replace('e AS', 'x AS', 1)}, {DELAYED}, {levels('p.d', 'p.m', 'e.d')}")
def path_delayed(spark: SparkSession, d: str) -> DataFrame:
    """NUM24: the same with a drive that acts 0.6 later."""
    return paths.integrate(path_rows(spark, d), "user_id", "t", "s", "a", "r", 0.3, lag=0.6)
