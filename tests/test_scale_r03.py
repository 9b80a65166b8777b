"""Steps that were too slow or too large: same results, in bounded pieces."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from spindrift.operators import diffusion, graphs, index, profiles, transport, vectors

DATA = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().toString()


@pytest.fixture(scope="module")
def points():
    x = np.random.default_rng(1).normal(size=(160, 6)).astype(np.float32)
    x[100:120] = x[0]  # copies
    return x


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(t) for t in v]) for i, v in enumerate(x)], "id long, vec array<float>")


def test_energy_meets_each_pair_of_tiles_of_a_side_once(spark, points, monkeypatch):
    monkeypatch.setattr(index, "TILE", 20)
    met, real = [], index.met_tiles

    def counted(q, m, pairs, kernel, schema):
        met.append((q.count(), m.count(), pairs.count()))
        return real(q, m, pairs, kernel, schema)

    monkeypatch.setattr(index, "met_tiles", counted)
    a, b = points[:110].astype(float), points[110:].astype(float)
    mean = lambda p, q: np.sqrt(((p[:, None] - q[None]) ** 2).sum(-1)).mean()
    want = (2 * mean(a, b) - mean(a, a) - mean(b, b)) / mean(b, b)
    got = vectors.energy_distance(frame(spark, points[:110]), frame(spark, points[110:], 110)).first().energy
    assert abs(got - want) < 1e-9
    (n, m, ab), (_, _, aa_off), (_, _, aa), (_, _, bb_off), (_, _, bb) = met
    assert ab == n * m and (aa_off, aa) == (n * (n - 1) // 2, n) and (bb_off, bb) == (m * (m - 1) // 2, m)


@pytest.mark.parametrize("include_self", [False, True])
def test_nearest_few_by_products_equal_all_differences(points, include_self):
    x, ids = points.astype(float), np.arange(160) * 7 % 160
    x[5] = np.nan
    got = index.nearest_few(ids, x, ids, x, 9, include_self)
    for i, v in zip(ids, x):
        d = np.round(np.sqrt(((x - v) ** 2).sum(1)), 12)
        allowed = np.flatnonzero((ids != i) | include_self)
        top = allowed[np.lexsort((ids[allowed], d[allowed]))[:9]]
        own = got[got.id == i]
        assert own.neighbour.tolist() == ids[top].tolist() and np.array_equal(own.distance, d[top], equal_nan=True)


def test_coherence_searches_its_neighbours_once(spark):
    assert "MapInPandas" not in plan_of(queries()["vec_neighbour_coherence"](spark, DATA))


def test_rank_sum_by_counts(spark, monkeypatch):
    r = np.random.default_rng(2)
    rows = [(g, m, float(v)) for g in "abc" for m in ("x", "y") for v in r.integers(0, 12, 40)] + [("a", "x", None), ("c", "x", None), ("b", "z", 1.0)]
    got = profiles.rank_sum(spark.createDataFrame(rows, "grp string, measure string, value double"), "c")
    assert "windowspecdefinition(grp" not in plan_of(got)
    got = {(t.grp, t.measure): t for t in got.collect()}
    alone = got.pop(("b", "z"))  # no control there
    assert (alone.u, alone.z) == (0.0, None) and set(got) == {(g, m) for g in "ab" for m in "xy"}
    for (g, m), t in got.items():
        own, other = (np.array([99.0 if v is None else v for a, b, v in rows if (a, b) == (k, m)]) for k in (g, "c"))
        both = np.concatenate([own, other])
        rank = np.array([(both < v).sum() + ((both == v).sum() + 1) / 2 for v in both])
        n1, n2, n = len(own), len(other), len(both)
        u = rank[:n1].sum() - n1 * (n1 + 1) / 2
        _, c = np.unique(both, return_counts=True)
        sd = np.sqrt(n1 * n2 / 12 * (n + 1 - (c.astype(float) ** 3 - c).sum() / (n * (n - 1))))
        assert t.u == u and abs(t.z - (abs(u - n1 * n2 / 2) - 0.5) / sd) < 1e-12


def test_quantiles_read_the_rows_once(spark):
    files = queries()["agg_wasserstein"](spark, DATA).inputFiles()
    assert files and not [f for f in files if "lineitem" in f]


def test_components_deal_the_nodes_of_one_label(spark, monkeypatch):
    monkeypatch.setattr(graphs, "SALTS", 3)
    edges = [(0, i) for i in range(1, 40)] + [(i, i + 1) for i in range(50, 90)] + [(100, 100)]
    got = dict(graphs.components(spark.createDataFrame(edges, "src long, dst long")).collect())
    assert got == {**{i: 0 for i in range(40)}, **{i: 50 for i in range(50, 91)}, 100: 100}


def test_diffusion_searches_its_neighbours_once(spark):
    edges = spark.range(30).select(F.col("id").alias("src"), ((F.col("id") + 1) % 30).alias("dst"), F.lit(1.0).alias("distance"))
    assert "MapInPandas" not in plan_of(diffusion.transitions(diffusion.united(diffusion.memberships(edges))))


def test_transport_in_blocks_and_chunks(spark, points, monkeypatch):
    x = frame(spark, points).select(F.lit(1).alias("grp"), "id", F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("side"), "vec")
    assert transport.blocked(x, "a").schema["flat"].dataType.simpleString() == "array<float>"

    def rows():
        return {r.src: (r.dst, r.share, r.mass, r.entropy) for r in transport.rows_of(transport.sinkhorn(x, 0.5, 2)).collect()}

    whole = rows()
    monkeypatch.setattr(transport, "BLOCK", 30)
    real = transport.costs
    assert len(list(real(points[:, :].ravel(), 160, points.ravel(), 160, 1.0))) == 1
    monkeypatch.setattr(transport, "CHUNK", 7)
    parts = list(real(points.ravel(), 160, points.ravel(), 160, 1.0))
    assert len(parts) == 23 and max(c.shape[0] for _, c in parts) == 7
    cut = rows()
    assert whole.keys() == cut.keys() and all(np.allclose(whole[k][1:], cut[k][1:], rtol=1e-9) for k in whole)
