"""Diffusion pseudotime and geodesics against NumPy and a plain search."""

import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.operators import diffusion, graphs, spectral
from spindrift.sources.shared import write_table


def knn(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    return d, near


def expected(x, k, comps, root):
    d, near = knn(x, k)
    n = len(x)
    w = np.zeros((n, n))
    for i in range(n):
        dist = d[i, near[i]]
        away = dist - dist[dist > 0].min()
        lo, hi = 1e-9, 1e9
        for _ in range(200):
            mid = (lo * hi) ** 0.5
            lo, hi = (lo, mid) if np.exp(-away / mid).sum() > np.log2(k + 1) else (mid, hi)
        w[i, near[i]] = np.exp(-away / max(lo, 1e-3 * dist.mean()))
    w = w + w.T - w * w.T
    q = w.sum(0)
    kk = w / np.outer(q, q)
    z = np.sqrt(kk.sum(0))
    values, vectors = np.linalg.eigh(kk / np.outer(z, z))
    values, vectors = values[::-1][:comps], vectors[:, ::-1][:, :comps]
    f = np.where(values >= diffusion.STEADY, 1.0, values / (1 - values))
    t = np.sqrt((((vectors - vectors[root]) * f) ** 2).sum(1))
    return t / t.max()


def test_pseudotime_follows_a_curve(spark):
    r = np.random.default_rng(7)
    s = np.sort(r.random(80))
    x = np.column_stack([np.cos(3 * s), np.sin(3 * s), s]) + r.normal(size=(80, 3)) * 0.02
    d, near = knn(x, 8)
    edges = spark.createDataFrame([(i, int(j), float(d[i, j])) for i in range(80) for j in near[i]], "src long, dst long, distance double")
    want = expected(x, 8, 4, 0)
    got = {t.id: t.pseudotime for t in diffusion.pseudotime(edges, 0, 4).collect()}
    assert len(got) == 80 and max(abs(got[i] - want[i]) for i in range(80)) < 1e-4
    assert np.corrcoef(np.argsort(np.argsort(want)), np.arange(80))[0, 1] > 0.95
    with pytest.raises(ValueError):
        diffusion.pseudotime(edges, 999, 2)


def test_geodesics(spark):
    r = np.random.default_rng(3)
    links = [(int(a), int(b), float(w)) for a, b, w in zip(r.integers(0, 60, 90), r.integers(0, 60, 90), r.random(90) + 0.1)] + [(100, 101, 2.0)]
    df = spark.createDataFrame(links, "src long, dst long, w double")
    near = {}
    for a, b, w in links:
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))

    def plain(start, weighted):
        best, heap = {}, [(0.0, start)]
        while heap:
            dist, node = heapq.heappop(heap)
            if node not in best:
                best[node] = dist
                for other, w in near.get(node, []):
                    heapq.heappush(heap, (dist + (w if weighted else 1), other))
        return best

    sources = spark.createDataFrame([(0,), (5,), (100,), (999,), (5,)], "source long")
    for weight in (None, "w"):
        got = {(g.source, g.node): g.distance for g in graphs.geodesics(df, sources, weight).collect()}
        want = {(s, n): x for s in (0, 5, 100, 999) for n, x in plain(s, weight).items()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert graphs.geodesics(df, sources.limit(0)).count() == 0


def test_close_values_settle(spark):
    """A ring, whose leading values differ by a few hundredths: restarts alone take about eight of them."""
    n = 90
    ring = spark.createDataFrame([(i, (i + s) % n, w) for i in range(n) for s, w in ((-1, 0.25), (0, 0.5), (1, 0.25))], "row long, col long, value double")
    keys = write_table(ring.select(F.col("row").alias("key")).distinct(), "ring")
    vectors, values = spectral.leading_eigen(lambda block, width: spectral.times(ring, block, "col", "row", width, n), keys, 4, steps=5, tolerance=1e-6, restarts=4)
    assert np.abs(2 * values - 1 - np.cos(2 * np.pi * np.array([0, 1, 1, 2]) / n)).max() < 1e-9
    v = np.array([r.v for r in vectors.orderBy("key").collect()])
    assert np.abs((np.roll(v, 1, 0) + 2 * v + np.roll(v, -1, 0)) / 4 - v * values).max() < 1e-5
    assert np.abs(v.T @ v - np.eye(4)).max() < 1e-9
