"""Similarity of embedding rows: queries against all rows in blocks, never as joined pairs of rows.

Both sides are packed into blocks of vectors; every block of queries meets every block of candidates in a
NumPy kernel that returns one small partial result per query (counts, or its nearest few), which Spark then
merges. A task holds two blocks, so memory stays the same at any size. Distances are Euclidean, in double.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import write_table
from . import index

#: Vectors of a block of structs.
BLOCK = 1024


def packed(df: DataFrame, key: str, columns: list[str], prefix: str) -> DataFrame:
    """Rows of at most about BLOCK collected vectors; the number of blocks follows a count."""
    blocks = max(1, -(-df.count() // BLOCK))
    x = df.select(*columns).withColumn("_b", F.pmod(F.xxhash64(key), F.lit(blocks)))
    return x.groupBy("_b").agg(F.collect_list(F.struct(*columns)).alias(f"{prefix}_rows")).select(f"{prefix}_rows")


def block_pairs(queries: DataFrame, candidates: DataFrame, key: str, kernel: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``kernel`` of every (query block, candidate block)."""
    q, c = packed(queries, key, queries.columns, "q"), packed(candidates, key, candidates.columns, "c")
    pairs = q.crossJoin(c)  # blocks, not rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for qs, cs in zip(b.q_rows, b.c_rows, strict=True):
                yield kernel(pd.DataFrame(list(qs)), pd.DataFrame(list(cs)))

    return pairs.mapInPandas(run, schema)


def _matrix(col: pd.Series) -> np.ndarray:
    return np.stack(col.to_numpy()).astype(np.float64)


def foscttm(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per query (id, a, partner vector b, grp): share of candidates (id, b, grp) of its group strictly closer to
    ``a`` than its partner. Groups of one row give null."""

    def kernel(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out, vs, g = [], _matrix(c.b), c.grp.to_numpy()
        for i, a, b, grp in zip(q.id, q.a, q.b, q.grp, strict=True):
            own = g == grp
            d = np.sqrt(((vs[own] - np.asarray(a, np.float64)) ** 2).sum(1))
            true = np.sqrt(((np.asarray(b, np.float64) - np.asarray(a, np.float64)) ** 2).sum())
            out.append((i, grp, int((d < true - 1e-12).sum()), int(own.sum())))
        return pd.DataFrame(out, columns=["id", "grp", "closer", "n"])

    parts = block_pairs(queries.select("id", "a", "b", "grp"), candidates.select("id", "b", "grp"), "id", kernel, "id long, grp int, closer long, n long")
    s = parts.groupBy("id", "grp").agg(F.sum("closer").alias("closer"), F.sum("n").alias("n"))
    return s.select("id", "grp", "closer", "n", F.when(F.col("n") > 1, F.col("closer") / (F.col("n") - 1)).alias("foscttm"))


def nearest(queries: DataFrame, candidates: DataFrame, k: int, include_self: bool = False) -> DataFrame:
    """The k nearest candidates (id, vec) of each query (id, vec): (id, neighbour, distance, rank); ties by id."""

    one = F.lit(0).alias("lst")
    return index.nearest_in_lists(queries.select("id", "vec", one), candidates.select("id", "vec", one), k, include_self)


def label_vote(near: DataFrame, labels: DataFrame) -> DataFrame:
    """Majority label of the neighbours; ties: the smallest label."""
    votes = near.join(labels.select(F.col("id").alias("neighbour"), "label"), "neighbour").groupBy("id", "label").agg(F.count("*").alias("n"))
    return votes.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("m")).select("id", F.col("m.label").alias("predicted"))


def inverse_simpson(near: DataFrame, labels: DataFrame) -> DataFrame:
    """1 / sum of squared label shares among each query's neighbours."""
    votes = near.join(labels.select(F.col("id").alias("neighbour"), "label"), "neighbour").groupBy("id", "label").agg(F.count("*").alias("n"))
    return votes.groupBy("id").agg((F.sum("n") * F.sum("n") / F.sum(F.col("n") * F.col("n"))).alias("ilisi"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labellings from their contingency counts."""
    two = lambda n: n * (n - 1) / 2
    n = df.groupBy(a, b).agg(F.count("*").alias("n"))
    cell = n.agg(F.sum(two(F.col("n"))).alias("s"), F.sum("n").alias("all"))
    rows, cols = (n.groupBy(k).agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias(f"s_{i}")) for i, k in enumerate((a, b)))
    x = cell.crossJoin(rows).crossJoin(cols)  # one row each
    expected = F.col("s_0") * F.col("s_1") / two(F.col("all"))
    top = (F.col("s_0") + F.col("s_1")) / 2
    return x.select(F.when(top != expected, (F.col("s") - expected) / (top - expected)).otherwise(1.0).alias("ari"))


def distance_sum(x: np.ndarray, y: np.ndarray, chunk: int = 256) -> float:
    """Sum of the distances of all rows of two matrices, by products; those too short for a product's digits by differences."""
    total = 0.0
    for first in range(0, len(x), chunk):
        v = x[first : first + chunk]
        d, error = index.squared(v, y)
        rows, cols = np.nonzero(d <= 1e4 * error[:, None])
        for at in range(0, len(rows), 1 << 16):
            r, c = rows[at : at + (1 << 16)], cols[at : at + (1 << 16)]
            d[r, c] = ((y[c] - v[r]) ** 2).sum(1)
        total += float(np.sqrt(d).sum())
    return total


def energy_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """(2 E|a-b| - E|a-a'| - E|b-b'|) / E|b-b'|, over all pairs of rows; null where E|b-b'| is 0.

    Every row of both sides asks, in tiles: the work grows with the square of the rows, memory doesn't. Inside a side a
    pair of tiles is met once and counts twice."""
    one = F.lit(0).alias("lst")
    x, y = (write_table(index.tiles(df.select("id", "vec", one), index.TILE, "m"), "energy") for df in (a, b))

    def mean(left: DataFrame, right: DataFrame, same: bool, name: str) -> DataFrame:
        q = left.withColumnsRenamed({"mt": "qt", "m_ids": "q_ids", "m_flat": "q_flat"})
        pairs = q.select("lst", "qt").join(right.select("lst", "mt"), "lst")  # numbers of tiles only
        if same:
            once = pairs.filter("qt < mt"), pairs.filter("qt = mt")
        else:
            once = (pairs,)

        def kernel(_q, v, _m, w):
            return pd.DataFrame({"n": [len(v) * len(w)], "total": [distance_sum(v, w)]})

        sums = [index.met_tiles(q, right, p, kernel, "n long, total double").select(*(F.col(c) * (2 if same and i == 0 else 1) for c in ("n", "total"))).toDF("n", "total") for i, p in enumerate(once)]
        return (sums[0].unionByName(sums[1]) if same else sums[0]).agg((F.sum("total") / F.sum("n")).alias(name))

    one = mean(x, y, False, "ab").crossJoin(mean(x, x, True, "aa")).crossJoin(mean(y, y, True, "bb"))  # one row each
    return one.select(((2 * F.col("ab") - F.col("aa") - F.col("bb")) / F.when(F.col("bb") > 0, F.col("bb"))).alias("energy"))


def silhouette(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per query (id, vec, label): mean distance to the rows of its label and to the nearest other label, as
    (other - own) / the larger; 0 for a row that is alone in its label. One partial sum per query, label and block."""

    def kernel(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        vs, labels = _matrix(c.vec), c.label.to_numpy()
        known, which = np.unique(labels, return_inverse=True)
        out = []
        for i, v, own in zip(q.id, q.vec, q.label, strict=True):
            dist = np.sqrt(((vs - np.asarray(v, np.float64)) ** 2).sum(1))
            out.append(pd.DataFrame({"id": i, "label": own, "other": known, "total": np.bincount(which, dist, len(known)), "n": np.bincount(which, minlength=len(known))}))
        return pd.concat(out, ignore_index=True)

    parts = block_pairs(queries.select("id", "vec", "label"), candidates.select("id", "vec", "label"), "id", kernel, "id long, label int, other int, total double, n long")
    s = parts.groupBy("id", "label", "other").agg(F.sum("total").alias("t"), F.sum("n").alias("n"))
    own = F.max(F.when((F.col("other") == F.col("label")) & (F.col("n") > 1), F.col("t") / (F.col("n") - 1)))
    out = s.groupBy("id", "label").agg(own.alias("own"), F.min(F.when(F.col("other") != F.col("label"), F.col("t") / F.col("n"))).alias("near"))
    return out.filter("near is not null").select("id", "label", F.when(F.col("own").isNull(), 0.0).otherwise((F.col("near") - F.col("own")) / F.greatest("near", "own")).alias("silhouette"))


def mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """Mutual information of two labellings, and normalised by the mean of their entropies, from contingency counts."""
    n = df.groupBy(a, b).agg(F.count("*").cast("double").alias("n"))
    all_ = n.agg(F.sum("n").alias("t"))
    x = n.join(n.groupBy(a).agg(F.sum("n").alias("na")), a).join(n.groupBy(b).agg(F.sum("n").alias("nb")), b).crossJoin(F.broadcast(all_))  # one row
    mi = F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("na") * F.col("nb"))))
    # a row's share of its label's entropy: n / t * -ln(na / t), which adds up to the entropy
    entropies = [-F.sum(F.col("n") / F.col("t") * F.log(F.col(k) / F.col("t"))) for k in ("na", "nb")]
    one = x.agg(mi.alias("mi"), *(h.alias(f"h{i}") for i, h in enumerate(entropies)))
    total = F.col("h0") + F.col("h1")
    return one.select(F.col("mi").alias("mutual_information"), F.when(total > 0, 2 * F.col("mi") / total).otherwise(1.0).alias("nmi"))


def correlations(df: DataFrame) -> DataFrame:
    """Pearson correlations of the columns i < j of ``vec``. Every task sends one matrix of sums, whatever its rows."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s, q, n = None, None, 0
        for b in batches:
            if len(b):
                m = _matrix(b.vec)
                s, q, n = (m.sum(0), m.T @ m, len(m)) if s is None else (s + m.sum(0), q + m.T @ m, n + len(m))
        if n:
            i, j = np.triu_indices(len(s))
            yield pd.DataFrame({"i": i, "j": j, "n": n, "x": s[i], "y": s[j], "xy": q[i, j]})

    g = df.select("vec").mapInPandas(sums, "i long, j long, n long, x double, y double, xy double")
    g = g.groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in ("n", "x", "y", "xy"))).withColumn("cov", F.col("xy") / F.col("n") - F.col("x") / F.col("n") * F.col("y") / F.col("n"))
    var = g.filter("i = j").select("i", "cov")
    both = g.filter("i < j").join(var.select("i", F.col("cov").alias("vi")), "i").join(var.select(F.col("i").alias("j"), F.col("cov").alias("vj")), "j")
    spread = F.sqrt(F.col("vi") * F.col("vj"))
    return both.select("i", "j", F.when(spread > 1e-12, F.col("cov") / F.when(spread > 1e-12, spread)).alias("corr"))
