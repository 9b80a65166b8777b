"""Graphs, transport and streams."""

import numpy as np
import pytest

from spindrift.operators import graphs, transport, vectors
from spindrift.streaming import events


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (200, 200)]
    got = {r.node: r.component for r in graphs.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[100] == got[101] == 100 and got[200] == 200


def test_stitching_gives_control_rows_control_edges_only(spark):
    full = spark.createDataFrame([(1, 2, 1.0), (3, 1, 1.0), (2, 3, 1.0)], "src long, dst long, weight double")
    control = spark.createDataFrame([(1, 2, 5.0), (2, 1, 5.0), (1, 3, 5.0)], "src long, dst long, weight double")
    fit = spark.createDataFrame([(1, True), (2, True), (3, False)], "row long, is_control boolean")
    assert {tuple(r) for r in graphs.stitched(full, control, fit).collect()} == {(3, 1, 1.0), (1, 2, 5.0), (2, 1, 5.0)}


def test_components_equal_union_find(spark):
    rng = np.random.default_rng(3)
    edges = [(int(x), int(y)) for x, y in rng.integers(0, 120, (70, 2))]
    parent = list(range(120))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in edges:
        parent[max(find(x), find(y))] = min(find(x), find(y))
    got = {r.node: r.component for r in graphs.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for e in edges for x in e} and len(set(got.values())) > 5


@pytest.mark.parametrize("block", [1024, 3])
def test_transport_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(transport, "BLOCK", block)
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(7, 3)), rng.normal(size=(5, 3))
    plan, k, f, g = plan_of(a, b, 0.5, 4)
    rows = [(0, i, "a", v.tolist(), [float(i), 1.0]) for i, v in enumerate(a)] + [(0, 100 + i, "b", v.tolist(), v[:2].tolist()) for i, v in enumerate(b)] + [(1, 9, "a", [0.0, 0.0, 0.0], [0.0, 0.0])]
    df = spark.createDataFrame(rows, "grp int, id long, side string, vec array<double>, payload array<double>")
    got = {r.src: r for r in transport.rows_of(transport.sinkhorn(df, 0.5, 4)).collect()}
    assert len(got) == 7 and all(r.grp == 0 for r in got.values())
    for i, r in got.items():
        row = plan[i] / plan[i].sum()
        entropy = -(row * np.log(row)).sum()
        assert r.dst == 100 + plan[i].argmax() and abs(r.share - row.max()) < 1e-9 and abs(r.mass - plan[i].sum()) < 1e-9
        assert abs(r.entropy - entropy) < 1e-9 and abs(r.confidence - max(0, 1 - entropy / np.log(5))) < 1e-9
        assert np.allclose(r.projected, row @ b[:, :2])


def plan_of(a, b, epsilon, rounds, scaled=True):
    cost = ((a[:, None] - b[None]) ** 2).sum(-1)
    k = -cost / (np.sort(cost.ravel())[(cost.size - 1) // 2] if scaled else 1.0) / epsilon
    f, g = np.zeros(len(a)), np.zeros(len(b))
    soft = lambda x, axis: np.log(np.exp(x).sum(axis))
    for _ in range(rounds):
        f = -np.log(len(a)) - soft(k + g[None], 1)
        g = -np.log(len(b)) - soft(k + f[:, None], 0)
    return np.exp(k + f[:, None] + g[None]), k, f, g


def test_penalised_margins_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(transport, "BLOCK", 4)
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(6, 2)), rng.normal(size=(5, 2))
    a[0] += 9  # far from everything
    cost = ((a[:, None] - b[None]) ** 2).sum(-1)
    k, held = -cost / np.sort(cost.ravel())[(cost.size - 1) // 2] / 0.2, 0.5 / 0.7
    f, g = np.zeros(6), np.zeros(5)
    soft = lambda x, axis: np.log(np.exp(x).sum(axis))
    for _ in range(3):
        f = -np.log(6) - held * soft(k + g[None], 1)
        g = -np.log(5) - held * soft(k + f[:, None], 0)
    mass = np.exp(k + f[:, None] + g[None]).sum(1)
    rows = [(0, i, s, v.tolist()) for s, x in (("a", a), ("b", b)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "grp int, id long, side string, vec array<double>")
    got = {r.src: r.mass for r in transport.rows_of(transport.sinkhorn(df, 0.2, 3, penalty=0.5)).collect()}
    assert all(abs(got[i] - mass[i]) < 1e-9 for i in range(6)) and mass[0] < mass[1:].min()


def test_retrieval_and_divergence_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(transport, "BLOCK", 4)
    rng = np.random.default_rng(4)
    a = rng.normal(size=(9, 3))
    b = a + rng.normal(size=(9, 3)) * 0.6
    rows = [(2, i, s, v.tolist()) for s, x in (("a", a), ("b", b)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "grp int, id long, side string, vec array<double>")
    plan, *_ = plan_of(a, b, 0.3, 3)
    t = np.diag(plan)
    ranks = np.concatenate([(plan > t[:, None] * (1 + 1e-9)).sum(1), (plan > t[None] * (1 + 1e-9)).sum(0)])
    got = transport.retrieval(transport.sinkhorn(df, 0.3, 3)).first()
    assert abs(got.foscttm - (ranks / 8).mean()) < 1e-9 and abs(got.top1 - (ranks < 1).mean()) < 1e-9 and got.top10 == 1.0

    def value(x, y):
        _, _, f, g = plan_of(x, y, 0.7, 4, False)
        return 0.7 * (f.mean() + g.mean() + np.log(len(x)) + np.log(len(y)))

    got = transport.divergence(df, 0.7, 4).first().divergence
    assert abs(got - (value(a, b) - value(a, a) / 2 - value(b, b) / 2)) < 1e-9


def test_energy_distance_of_equal_sets_is_zero(spark):
    df = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(10)], "id long, vec array<double>")
    assert abs(vectors.energy_distance(df, df).first().energy) < 1e-9
    same = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(3)], "id long, vec array<double>")
    assert vectors.energy_distance(df, same).first().energy is None


def test_time_warping_equals_brute_force():
    from functools import cache

    from spindrift.plans.vectors import dtw

    rng = np.random.default_rng(2)
    for n, m in ((1, 1), (3, 5), (6, 4)):
        a, b = rng.normal(size=n), rng.normal(size=m)

        @cache
        def best(i, j):
            step = abs(a[i] - b[j])
            before = [best(x, y) for x, y in ((i - 1, j), (i, j - 1), (i - 1, j - 1)) if x >= 0 and y >= 0]
            return step + min(before, default=0.0)

        assert abs(dtw(a, b) - best(n - 1, m - 1) / (n + m)) < 1e-12


def test_quantiles_and_ranks_are_exact(spark):
    from pyspark.sql import functions as F

    from spindrift.operators import effects, profiles, ranks

    rng = np.random.default_rng(5)
    rows = [(g, float(v)) for g, n in (("a", 1), ("b", 2), ("c", 5000)) for v in np.where(rng.random(n) < 0.4, 0.0, rng.normal(size=n))]
    df = spark.createDataFrame([*rows, ("c", None), ("d", None)], "g string, v double")
    shares = (0.0, 0.05, 0.5, 0.731, 1.0)
    got = {(r.g, r.share): r.quantile for r in profiles.exact_quantiles(df, ["g"], "v", shares, 20).collect()}
    for g in "abc":
        for s in shares:
            assert abs(got.pop((g, s)) - np.quantile([v for k, v in rows if k == g], s)) < 1e-12
    assert not got
    whole = ranks.numbered(df.filter("v is not null").withColumn("i", F.monotonically_increasing_id()), F.col("v"), F.col("i")).select("v", "_r").orderBy("_r").collect()
    assert [r._r for r in whole] == list(range(1, len(rows) + 1)) and [r.v for r in whole] == sorted(v for _, v in rows)
    p = [float(x) for x in rng.random(300) ** 3] + [None, None]
    q = {r.i: r.q for r in effects.bh_qvalues(spark.createDataFrame(list(enumerate(p)), "i int, p double")).collect()}
    order = sorted(range(300), key=lambda i: p[i])
    low = 1.0
    for k in range(300, 0, -1):
        low = min(low, p[order[k - 1]] * 300 / k)
        assert abs(q[order[k - 1]] - low) < 1e-12
    assert q[300] is None and q[301] is None


def test_streams_equal_batches_over_several_files(spark, tmp_path):
    rows = [(i, f"2024-01-0{1 + i % 3} 0{i % 10}:00:00", i % 4, "k", float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").selectExpr("event_id", "cast(ts as timestamp_ntz) as ts", "user_id", "event_type", "value")
    path = str(tmp_path / "events.parquet")
    df.repartition(4).write.parquet(path)
    stream = events.event_stream(spark, path, files_per_trigger=1)
    got = events.drain(events.tumbling(stream, "event_type", "value"), "complete").collect()
    assert len(got) == 3 and sum(r.n for r in got) == 40
    sums = events.drain(events.incremental_sums(events.event_stream(spark, path, 1), "user_id"), "complete").collect()
    assert {r.user_id: r.total for r in sums} == {u: float(sum(i for i in range(40) if i % 4 == u)) for u in range(4)}
    closed = events.drain(events.sessions(events.event_stream(spark, path, 1), "user_id", "2 hours")).collect()
    assert all(r.end > r.start for r in closed)
