"""Integration with delay, stopping, and the edges of the conditions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.operators import conditions, paths


def plain(rows, decay, start, lag):
    t, s, a, r = (np.array(x, float) for x in zip(*rows))
    rhs = lambda x, p: np.interp(x, t, r) * (np.interp(x, t, a) * np.interp(x - lag, t, s) - decay * p)
    out = [start]
    for t0, t1 in zip(t, t[1:]):
        h, p = t1 - t0, out[-1]
        k1 = rhs(t0, p)
        k2 = rhs(t0 + h / 2, p + h / 2 * k1)
        k3 = rhs(t0 + h / 2, p + h / 2 * k2)
        k4 = rhs(t1, p + h * k3)
        out.append(max(0.0, p + h * (k1 + 2 * k2 + 2 * k3 + k4) / 6))
    return out


@pytest.mark.parametrize("lag", [0.0, 0.35, 2.0])
def test_paths_are_integrated_in_order(spark, lag):
    r = np.random.default_rng(2)
    data = {k: [(float(t), *map(float, r.random(3) - [0.5, 0, 0])) for t in np.cumsum(r.random(n))] for k, n in ((1, 1), (2, 7), (3, 40))}
    rows = [(k, *x) for k, part in data.items() for x in part] + [(2, None, 1.0, 1.0, 1.0), (2, 0.5, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "k int, t double, s double, a double, r double").repartition(5)
    got = {}
    for g in paths.integrate(df, "k", "t", "s", "a", "r", 0.4, 0.2, lag).collect():
        got.setdefault(g.k, []).append((g.t, g.level))
    for k, part in data.items():
        assert np.allclose([x for _, x in sorted(got[k])], plain(part, 0.4, 0.2, lag))
    assert paths.integrate(df.limit(0), "k", "t", "s", "a", "r", 0.4).count() == 0


def test_patience(spark):
    rows = [("a", i, v) for i, v in enumerate([5.0, 4.0, 4.0, 4.5, 3.0])] + [("b", i, v) for i, v in enumerate([1.0, None, 2.0, 0.5])]
    df = spark.createDataFrame(rows, "k string, t int, v double")
    got = {r.k: (r.stop, r.best, r.value) for r in paths.stopped(df, "k", "t", F.col("v"), 2).collect()}
    assert got == {"a": (4, 2, 4.0), "b": (3, 1, 1.0)}


def test_edges_of_conditions(spark):
    x = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(4)], "id long, v array<double>")
    with pytest.raises(ValueError):
        conditions.corrupted(x, 1.5, 1)
    same = {r.id: r.v for r in conditions.corrupted(x, 0.0, 1).collect()}
    assert same == {i: [float(i), 0.0] for i in range(4)}
    nothing = x.select("id", F.array(F.lit(0.0), F.lit(0.0)).alias("v"))
    assert {tuple(r.v) for r in conditions.corrupted(nothing, 0.5, 1).collect()} == {(0.0, 0.0)}
    m = spark.createDataFrame([(r, c, v) for r, c, v in [(1, "a", 1.0), (2, "a", 2.0), (2, "b", 2.0), (3, "c", 1.0), (1, "b", 1.0)]], "row int, col string, value double")
    links = {(w.col, w.linked): w.weight for w in conditions.correlated_columns(m, 1).collect()}
    assert abs(links[("a", "b")] - 0.5) < 1e-9 and abs(links[("a", "a")] - 0.5) < 1e-9 and links[("c", "c")] == 1.0 and ("c", "a") not in links
    assert conditions.correlated_columns(m.limit(0), 1).count() == 0
