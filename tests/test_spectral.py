"""Factorisations against NumPy on whole small matrices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.operators import spectral
from spindrift.plans import factors
from spindrift.plans.registry import queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def embeddings(spark):
    rows = factors.dense(spark, DATA).orderBy("id").collect()
    return np.array([r.id for r in rows]), np.array([r.embedding for r in rows])


@pytest.fixture(scope="module")
def weights(spark):
    x, _ = factors.weighted(spark, DATA)
    cells = x.collect()
    rows, cols = sorted({c.row for c in cells}), sorted({c.col for c in cells})
    m = np.zeros((len(rows), len(cols)))
    for c in cells:
        m[rows.index(c.row), cols.index(c.col)] = c.value
    return np.array(rows), cols, m


def table_of(df, row, col, value):
    return {(r[row], r[col]): r[value] for r in df.collect()}


def test_principal_axes(spark, embeddings):
    ids, x = embeddings
    fit = x[ids % 3 == 0]
    _, s, vt = np.linalg.svd(fit - fit.mean(0), full_matrices=False)
    axes = spectral.fixed_signs(vt.T[:, : factors.COMPONENTS])
    got = table_of(queries()["fac_pca"](spark, DATA), "id", "component", "score")
    want = (x - fit.mean(0)) @ axes
    assert len(got) == want.size
    assert max(abs(got[i, k] - want[n, k]) for n, i in enumerate(ids.tolist()) for k in range(axes.shape[1])) < 2e-6
    var = s**2 / (len(fit) - 1)
    for r in queries()["fac_pca_axes"](spark, DATA).collect():
        assert abs(r.loading - axes[r.feature, r.component]) < 2e-6 and abs(r.share - var[r.component] / var.sum()) < 2e-6


def test_axes_of_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0, 3.0]), (1, [1.0, 2.0, 4.0]), (2, None)], "id int, v array<double>")
    mean, axes, var, share = spectral.principal_axes(df, "v", F.lit(True), 9)
    assert axes.ravel().tolist() == [0, 0, 1] and var.tolist() == [0.5] and share.tolist() == [1.0]
    assert spectral.project(df, "v", mean, axes, "z").orderBy("id").select("z").collect()[2].z is None
    with pytest.raises(ValueError):
        spectral.principal_axes(df.limit(0), "v", F.lit(True), 2)


def test_latent_semantic_indexing(spark, weights):
    rows, _, m = weights
    _, s, vt = np.linalg.svd(m[rows % 3 == 0], full_matrices=False)
    want = m @ vt[1 : factors.COMPONENTS].T
    got = table_of(queries()["fac_lsi"](spark, DATA), "row", "component", "score")
    g = np.array([[got[r, k] for k in range(factors.COMPONENTS - 1)] for r in rows.tolist()])
    signs = np.sign((g * want).sum(0))
    assert np.abs(g * signs - want).max() < 1e-4 * s[1]
    _, values = spectral.lsi(*factors.weighted(spark, DATA), factors.COMPONENTS)
    assert np.allclose(values, s[: factors.COMPONENTS], rtol=1e-9)


def test_low_rank_form(spark, weights):
    rows, cols, m = weights
    fit = m[rows % 3 == 0]
    c = fit.mean(0)
    _, _, vt = np.linalg.svd(fit - c, full_matrices=False)
    v = vt[: factors.COMPONENTS]
    want = (m - c) @ v.T @ v + c
    got = table_of(queries()["fac_low_rank"](spark, DATA), "row", "col", "value")
    assert len(got) == want.size
    assert max(abs(got[r, k] - want[i, j]) for i, r in enumerate(rows.tolist()) for j, k in enumerate(cols)) < 1e-3


@pytest.mark.parametrize("shape", [(40, 30), (5, 40), (1, 1)])
def test_singular_vectors_of_small_and_degenerate_matrices(spark, shape):
    r = np.random.default_rng(shape[0])
    m = np.where(r.random(shape) < 0.4, r.normal(size=shape), 0.0)
    m[0, 0] = 2.0
    if shape[0] > 10:
        m[:, 3] = m[:, 2]  # rank below full
    df = spark.createDataFrame([(int(i), f"c{j:03d}", float(m[i, j])) for i, j in zip(*np.nonzero(m))], "row int, col string, value double")
    held = m[:, np.flatnonzero((m != 0).any(0))]
    for centre in (False, True):
        a = held - held.mean(0) * centre
        vectors, values, _ = spectral.truncated_svd(df, 3, centre, spark.range(shape[0]).select(F.col("id").alias("row")))
        s = np.linalg.svd(a, compute_uv=False)
        want = np.concatenate([s, np.zeros(3)])[: len(values)]
        assert np.allclose(values, want, atol=2e-6 * max(1.0, s[0]))
        v = np.array([x.v for x in vectors.orderBy("key").collect()])
        big = values > 1e-4 * max(values[0], 1e-9)
        assert np.allclose(np.linalg.norm(a @ v[:, big], axis=0), values[big], atol=1e-5)
        assert np.allclose(v[:, big].T @ v[:, big], np.eye(big.sum()), atol=1e-8)


def test_close_singular_values_need_no_restarts(spark, monkeypatch):
    m = np.random.default_rng(5).normal(size=(2000, 50)) + 3.0
    df = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(2000) for j in range(50)], "row int, col int, value double")
    a = m - m.mean(0)
    _, s, vt = np.linalg.svd(a, full_matrices=False)
    monkeypatch.setattr(spectral, "leading_eigen", None)
    vectors, values, _ = spectral.truncated_svd(df, 4, centre=True)
    v = np.array([x.v for x in vectors.orderBy("key").collect()])
    assert np.allclose(values, s[:4], rtol=1e-9) and np.allclose(np.abs((v * vt[:4].T).sum(0)), 1.0, atol=1e-8)


def test_iterated_vectors_equal_those_of_one_pass(spark, weights, monkeypatch):
    x, fit = factors.weighted(spark, DATA)
    vectors, values, _ = spectral.truncated_svd(x.join(fit, "row", "left_semi"), 3)
    monkeypatch.setattr(spectral, "NARROW", 0)
    others, again, _ = spectral.truncated_svd(x.join(fit, "row", "left_semi"), 3)
    assert np.allclose(values, again, rtol=1e-8)
    v, w = (np.array([r.v for r in d.orderBy("key").collect()]) for d in (vectors, others))
    assert np.abs(v - w).max() < 1e-5


def test_shuffled_blocks_equal_broadcast_ones(spark, weights, monkeypatch):
    x, fit = factors.weighted(spark, DATA)
    _, values = spectral.lsi(x, fit, 3)
    monkeypatch.setattr(spectral, "BROADCAST", 0)
    _, again = spectral.lsi(x, fit, 3)
    assert np.allclose(values, again, rtol=1e-8)


def test_ridge_and_leaving_one_out(spark, embeddings):
    ids, e = embeddings
    x, y = e[:, :32], e[:, 32:36]
    fit = ids % 3 == 0
    z = (x - x[fit].mean(0)) / x[fit].std(0)
    xf, yf = z[fit], y[fit]

    def solve(a, b, alpha):
        ma, mb = a.mean(0), b.mean(0)
        w = np.linalg.solve((a - ma).T @ (a - ma) + alpha * np.eye(a.shape[1]), (a - ma).T @ (b - mb))
        return w, mb - ma @ w

    errors = []
    for alpha in factors.ALPHAS[::8]:
        out = []
        for i in range(len(xf)):
            keep = np.arange(len(xf)) != i
            w, c = solve(xf[keep], yf[keep], alpha)
            out.append(((xf[i] @ w + c - yf[i]) ** 2).sum())
        errors.append(np.sum(out) / yf.size)
    got = queries()["fac_ridge_alphas"](spark, DATA).orderBy("alpha").collect()
    assert np.allclose([r.loo_error for r in got][::8], errors, atol=2e-6)
    alpha = next(r.alpha for r in got if r.chosen)
    w, c = solve(xf, yf, min(factors.ALPHAS, key=lambda a: abs(a - alpha)))
    want = z @ w + c
    p = table_of(queries()["fac_ridge"](spark, DATA), "id", "target", "predicted")
    assert max(abs(p[i, k] - want[n, k]) for n, i in enumerate(ids.tolist()) for k in range(4)) < 2e-6


def test_linear_ode(spark, embeddings):
    _, e = embeddings
    r, v, p = e[:, :8], e[:, 8:16], e[:, 16:20]
    q = v + 0.7 * r
    w = np.linalg.lstsq(r, p, rcond=None)[0].T
    for _ in range(50):
        a = np.linalg.lstsq(r, q @ w.T, rcond=None)[0].T
        w = np.linalg.lstsq(np.vstack([r, q]), np.vstack([p, r @ a.T]), rcond=None)[0].T
    got = queries()["fac_linear_ode"](spark, DATA).collect()
    for name, m in (("W", w), ("A", a)):
        assert np.allclose([[next(c.value for c in got if (c.matrix, c.i, c.j) == (name, i, j)) for j in range(m.shape[1])] for i in range(m.shape[0])], m, atol=2e-6)
    costs = [c.value for c in sorted((c for c in got if c.matrix == "cost"), key=lambda c: c.j)]
    assert len(costs) == 50 and all(b <= a + 1e-6 for a, b in zip(costs, costs[1:]))
    assert abs(costs[-1] - (((r @ w.T - p) ** 2).sum() + ((q @ w.T - r @ a.T) ** 2).sum())) < 1e-5
