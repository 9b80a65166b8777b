"""Nearest neighbours within lists: by label, or by an inverted-file index that covers every row.

The members of a list are packed into tiles of about ``TILE`` vectors; a list of pairs of tiles, by number alone, is joined
to the packed tiles, so that a list that holds a third of all rows is spread over many tasks and a task holds two tiles.

The index assigns every row to its nearest centroid; the centroids come from k-means on a bounded sample (``SAMPLE`` rows, the
first by a hash of the id). A search looks into the ``probes`` nearest lists of a query. ``calibrated`` measures recall against
brute force for the rows whose id is divisible by ``ask`` and doubles the probes until the target is reached, so the recall is known.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import write_table

#: Vectors of a tile, rows of the k-means sample (at 64 doubles 10 MB), lists at most, and rounds of k-means.
TILE, SAMPLE, LISTS, ROUNDS = 4096, 20_000, 4096, 10
#: Queries of a tile, and rows for which lists are sought, whose distances stand in memory at once.
CHUNK, ROWS = 128, 1024
#: Tiles of members that a tile of queries meets in one task.
MET = 16


def tiles(points: DataFrame, tile: int, prefix: str) -> DataFrame:
    """(lst, tile number, ids, vectors as one flat array) of (id, vec, lst)."""
    n = points.groupBy("lst").agg(F.count("*").alias("_n"))
    x = points.join(n, "lst").withColumn(f"{prefix}t", F.pmod(F.xxhash64("id"), F.ceil(F.col("_n") / tile)))
    packed = x.groupBy("lst", f"{prefix}t").agg(F.collect_list(F.struct("id", "vec")).alias("_p"))
    return packed.select("lst", f"{prefix}t", F.col("_p.id").alias(f"{prefix}_ids"), F.flatten("_p.vec").alias(f"{prefix}_flat"))


def squared(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of all rows of two matrices by one product, and a bound of their error for each row of ``x``."""
    nx, ny = (x * x).sum(1), (y * y).sum(1)
    return np.maximum(nx[:, None] + ny[None] - 2 * x @ y.T, 0.0), 1e-12 * (nx + np.nanmax(ny, initial=0.0))


def nearest_few(q_ids: np.ndarray, x: np.ndarray, m_ids: np.ndarray, y: np.ndarray, k: int, include_self: bool, best: pd.DataFrame | None = None) -> pd.DataFrame:
    """The k nearest rows of ``y`` of each row of ``x``, ties by id, as (row of x, id, neighbour, distance); ``best``, the result
    for other rows of ``y``, takes part. Products choose the rows that may be among them; only these are measured by
    differences, to 12 digits. A row with k neighbours in ``best`` has a bound already, so nothing is sorted for it."""
    kth, last = np.full(len(x), np.inf), min(k, len(y)) - 1
    if best is not None:
        full = best[best.groupby("row").cumcount() == k - 1]
        kth[full.row] = full.distance
    shared = not include_self and len(np.intersect1d(q_ids, m_ids)) > 0
    nx, ny, turned = (x * x).sum(1), (y * y).sum(1), np.ascontiguousarray(y.T)
    top = np.nanmax(ny, initial=0.0)
    room, dark = np.empty((min(CHUNK, len(x)), len(y))), np.empty((min(CHUNK, len(x)), len(y)), bool)
    out = [] if best is None else [best]
    for first in range(0, len(x), CHUNK):
        at, v, n = q_ids[first : first + CHUNK], x[first : first + CHUNK], nx[first : first + CHUNK]
        d = np.matmul(-2 * v, turned, out=room[: len(v)])
        d += ny  # squared distances less the norm of the query
        if shared:
            own = at[:, None] == m_ids[None]
            d[own] = np.inf
        error, bound = 1e-12 * (n + top), kth[first : first + CHUNK].copy()
        new = np.isinf(bound)
        if new.any():
            few = d if new.all() else d[new]
            few = np.partition(few, last, axis=1)[:, last] + n[new]
            bound[new] = np.sqrt(np.maximum(few, 0.0) + 2 * error[new])
        reach = (bound + 1e-11) ** 2 + 2 * error - n  # distances are compared after rounding
        far = np.greater(d, reach[:, None], out=dark[: len(v)])  # distances that are no numbers come last
        if shared:
            far |= own
        rows, cols = np.divmod(np.flatnonzero(~far), len(y))
        dist = np.empty(len(rows))
        for i in range(0, len(rows), 1 << 16):
            part = slice(i, i + (1 << 16))
            dist[part] = np.round(np.sqrt(((y[cols[part]] - v[rows[part]]) ** 2).sum(1)), 12)
        found = pd.DataFrame({"row": first + rows, "id": at[rows], "neighbour": m_ids[cols], "distance": dist})
        out.append(first_few(found, k) if len(found) > 4 * k * len(v) else found)
    return first_few(pd.concat(out, ignore_index=True), k)


def first_few(found: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest of each row, in order."""
    found = found.iloc[np.lexsort((found.neighbour, found.distance, found.row))]
    rows = found.row.to_numpy()
    return found[np.arange(len(rows)) - np.searchsorted(rows, rows) < k]


def met_tiles(q: DataFrame, m: DataFrame, pairs: DataFrame, kernel: Callable, schema: str) -> DataFrame:
    """``kernel(ids, vectors, ids, vectors)`` of every listed pair (lst, qt, mt) of tiles."""
    met = pairs.join(m, ["lst", "mt"]).join(q, ["lst", "qt"]).select("q_ids", "q_flat", "m_ids", "m_flat")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for q_ids, q_flat, m_ids, m_flat in zip(b.q_ids, b.q_flat, b.m_ids, b.m_flat, strict=True):
                x, y = (np.reshape(np.asarray(f, np.float64), (len(i), -1)) for i, f in ((q_ids, q_flat), (m_ids, m_flat)))
                yield kernel(np.asarray(q_ids), x, np.asarray(m_ids), y)

    return met.mapInPandas(run, schema)


def packed_members(members: DataFrame) -> DataFrame:
    """The tiles of (id, vec, lst), written."""
    return write_table(tiles(members, TILE, "m"), "index-members")


def nearest_in_lists(queries: DataFrame, members: DataFrame, k: int, include_self: bool = False) -> DataFrame:
    """(id, neighbour, distance, rank): the k nearest members (id, vec, lst) of each query (id, vec, lst) in its
    lists, itself left out unless ``include_self``; ties by id. A query may stand in several lists, a member in one."""
    m = packed_members(members)
    return nearest_in_tiles(as_queries(m) if queries is members else queries, m, k, include_self)


def as_queries(m: DataFrame) -> DataFrame:
    """Tiles of members, named as tiles of queries."""
    return m.select("lst", F.col("mt").alias("qt"), F.col("m_ids").alias("q_ids"), F.col("m_flat").alias("q_flat"))


def nearest_in_tiles(queries: DataFrame, m: DataFrame, k: int, include_self: bool = False) -> DataFrame:
    """``nearest_in_lists`` for members that ``packed_members`` has written; queries may be tiles already (``as_queries``)."""
    q = queries if "q_flat" in queries.columns else write_table(tiles(queries, TILE, "q"), "index-queries")
    # numbers of tiles only; a tile of queries meets up to MET tiles of members in one task, one after another
    pairs = q.select("lst", "qt").join(m.select("lst", "mt", F.floor(F.col("mt") / MET).alias("run")), "lst")
    runs = pairs.select("lst", "qt", "run").distinct().join(q, ["lst", "qt"])
    met = pairs.join(m, ["lst", "mt"]).join(runs, ["lst", "qt", "run"]).select("lst", "qt", "run", "q_ids", "q_flat", "m_ids", "m_flat")

    def search_tiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, best = None, None
        for b in batches:
            for lst, qt, run, q_ids, q_flat, m_ids, m_flat in b.itertuples(index=False):
                if key != (lst, qt, run):
                    if best is not None:
                        yield best[["id", "neighbour", "distance"]]
                    key, best, x = (lst, qt, run), None, np.reshape(np.asarray(q_flat, np.float64), (len(q_ids), -1))
                y = np.reshape(np.asarray(m_flat, np.float64), (len(m_ids), -1))
                best = nearest_few(np.asarray(q_ids), x, np.asarray(m_ids), y, k, include_self, best)
        if best is not None:
            yield best[["id", "neighbour", "distance"]]

    found = met.mapInPandas(search_tiles, "id long, neighbour long, distance double")
    order = W.partitionBy("id").orderBy("distance", "neighbour")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def fit_centroids(points: DataFrame, lists: int | None = None) -> np.ndarray:
    """k-means centroids of the sample; about the square root of the rows, at most ``LISTS``. Empty table: none."""
    n = points.count()
    lists = lists or int(min(LISTS, max(1, round(n**0.5))))
    sample = points.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vec").collect()
    x = np.array([r.vec for r in sample], np.float64)
    if not len(x):
        return np.zeros((0, 0))
    c = x[: min(lists, len(x))].copy()
    for _ in range(ROUNDS):
        near = nearest_lists(x, c, 1)[:, 0]
        count = np.bincount(near, minlength=len(c))
        for j in range(x.shape[1]):
            s = np.bincount(near, x[:, j], len(c))
            c[count > 0, j] = s[count > 0] / count[count > 0]
    return c


def nearest_lists(x: np.ndarray, c: np.ndarray, probes: int) -> np.ndarray:
    """Numbers of the ``probes`` nearest centroids of each row, the nearest first, ties by number; only those are sorted."""
    norms, probes = (c**2).sum(1), min(probes, len(c))
    out = np.empty((len(x), probes), np.int32)
    for first in range(0, len(x), ROWS):
        d = norms - 2 * x[first : first + ROWS] @ c.T
        d[np.isnan(d)] = np.inf
        if probes == 1:
            out[first : first + ROWS, 0] = d.argmin(1)
            continue
        rows, cols = np.nonzero(d <= np.partition(d, probes - 1, axis=1)[:, probes - 1 : probes])
        order = np.lexsort((cols, d[rows, cols], rows))
        rows, cols = rows[order], cols[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        out[first : first + ROWS] = cols[place < probes].reshape(-1, probes)
    return out


def assigned(points: DataFrame, centroids: np.ndarray, probes: int) -> DataFrame:
    """(id, vec, lst): each point in its ``probes`` nearest lists, the nearest first."""

    @F.pandas_udf("array<int>")
    def lists(v: pd.Series) -> pd.Series:
        return pd.Series(list(nearest_lists(np.stack(v.to_numpy()).astype(np.float64), centroids, probes)), dtype=object)

    return write_table(points.select("id", "vec", F.explode(lists("vec")).alias("lst")), "index-lists")  # it is read twice


def search(queries: DataFrame, points: DataFrame, centroids: np.ndarray, k: int, probes: int) -> DataFrame:
    """The k nearest points of each query in its ``probes`` nearest lists; every point stands in one list."""
    return nearest_in_lists(assigned(queries, centroids, probes), assigned(points, centroids, 1), k)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact neighbours that were found."""
    hit = exact.join(found.select("id", "neighbour"), ["id", "neighbour"], "left_semi").count()
    return hit / max(1, exact.count())


def calibrated(points: DataFrame, k: int, target: float = 0.95, ask: int = 20) -> tuple[np.ndarray, int, float]:
    """(centroids, probes, recall): the fewest probes, by doubling, whose measured recall reaches ``target``."""
    centroids = fit_centroids(points)
    asked = points.filter(F.col("id") % ask == 0)
    one = F.lit(0).alias("lst")
    exact = write_table(nearest_in_lists(asked.select("id", "vec", one), points.select("id", "vec", one), k), "index-exact")
    members = packed_members(assigned(points, centroids, 1))  # the same in every round
    probes = 1
    while True:
        got = recall(nearest_in_tiles(assigned(asked, centroids, probes), members, k), exact)
        if got >= target or probes >= len(centroids):
            return centroids, probes, got
        probes = min(2 * probes, len(centroids))


def graph(points: DataFrame, k: int, target: float = 0.95) -> DataFrame:
    """(src, dst, distance): the k nearest others of every row, by an index calibrated to ``target``."""
    centroids, probes, _ = calibrated(points, k, target)
    return search(points, points, centroids, k, probes).select(F.col("id").alias("src"), F.col("neighbour").alias("dst"), "distance")
