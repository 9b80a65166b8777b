"""Searches inside labels and hops: what was computed twice, or held as a row per pair, is not; same results."""

import collections

import numpy as np
import pandas as pd
import pytest

from spindrift.operators import graphs, index


def counted(monkeypatch, module, name):
    """Tables by name that ``module`` has written, with the plan behind each."""
    met, real = [], module.write_table

    def write(df, what):
        plan = df._jdf.queryExecution().executedPlan().toString() if what.endswith("edges") else ""
        out = real(df, what)
        met.append((what, out.count() if what == name else None, plan))
        return out

    monkeypatch.setattr(module, "write_table", write)
    return met


def plain_hops(links, sources):
    near = collections.defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    want = {}
    for s in sources:
        want[s, s], todo = 0.0, collections.deque([s])
        while todo:
            n = todo.popleft()
            for o in near[n]:
                if (s, o) not in want:
                    want[s, o] = want[s, n] + 1
                    todo.append(o)
    return want


@pytest.mark.parametrize("words, within", [(1, None), (1, "w"), (4, "w"), (4, None)])
def test_hops_hold_a_row_per_block_and_node(spark, monkeypatch, words, within):
    monkeypatch.setattr(graphs, "WORDS", words)
    r = np.random.default_rng(6)
    links = [(int(a) + g, int(b) + g) for g in (0, 1000) for a, b in zip(r.integers(0, 90, 200), r.integers(0, 90, 200))]
    sources = [*range(80), *range(1000, 1070), 5000]  # more than a word of 64; the last has no edge
    df = spark.createDataFrame(links, "src long, dst long")
    asked = spark.createDataFrame([(s, s // 1000) for s in [*sources, 3]], "source long, w int")
    rounds = counted(monkeypatch, graphs, "geodesics")
    found = graphs.geodesics(df, asked, within=within).collect()
    got = {(g.source, g.node): g.distance for g in found}
    assert got == plain_hops(links, sources) and len(found) == len(got)
    nodes = len({n for e in links for n in e} | set(sources))
    blocks = -(-len(sources) // (64 * words))
    most = max(n for what, n, _ in rounds if what == "geodesics")
    assert most <= nodes * blocks and most < len(got) / 10


def test_searched_edges_are_computed_once(spark, monkeypatch):
    x = np.random.default_rng(7).normal(size=(60, 4))
    v = spark.createDataFrame([(i, [float(t) for t in p], i % 2) for i, p in enumerate(x)], "id long, vec array<float>, lst int")
    packed, real = [], index.tiles
    monkeypatch.setattr(index, "tiles", lambda points, tile, prefix: packed.append(prefix) or real(points, tile, prefix))
    e = index.nearest_in_lists(v, v, 3).selectExpr("id as src", "neighbour as dst")
    assert packed == ["m"]  # the queries are the members
    made = counted(monkeypatch, graphs, "")
    graphs.components(e)
    graphs.geodesics(e, v.selectExpr("id as source").filter("id % 10 = 0"))
    graphs.geodesics(e.selectExpr("src", "dst", "1.5 as w"), v.selectExpr("id as source").filter("id % 10 = 0"), "w")
    plans = [p for what, _, p in made if what.endswith("edges")]
    assert len(plans) == 3 and all(p.count("MapInPandas") == 1 for p in plans)


@pytest.mark.parametrize("include_self", [False, True])
def test_tiles_met_one_after_another_equal_all_at_once(include_self):
    r = np.random.default_rng(8)
    x = r.normal(size=(150, 5)).astype(np.float32).astype(float)
    x[100:120], x[7], x[130:135] = x[0], np.nan, np.nan  # copies, no numbers
    ids = r.permutation(150)
    want = index.nearest_few(ids, x, ids, x, 12, include_self).reset_index(drop=True)
    best = None
    for part in np.array_split(r.permutation(150), 21):  # tiles of fewer rows than are sought
        best = index.nearest_few(ids, x, ids[part], x[part], 12, include_self, best)
    pd.testing.assert_frame_equal(best.reset_index(drop=True), want)


@pytest.mark.parametrize("met", [1, 2, 16])
def test_runs_of_tiles_equal_brute_force(spark, monkeypatch, met):
    monkeypatch.setattr(index, "TILE", 15)
    monkeypatch.setattr(index, "MET", met)
    x = np.random.default_rng(9).integers(0, 4, (120, 3)).astype(float)  # many ties
    v = spark.createDataFrame([(i, [float(t) for t in p], int(i > 30)) for i, p in enumerate(x)], "id long, vec array<float>, lst int")
    for queries in (v, v.filter("id % 3 = 0")):
        got = {}
        for n in index.nearest_in_lists(queries, v, 6).orderBy("id", "rank").collect():
            got.setdefault(n.id, []).append(n.neighbour)
        for i in (q.id for q in queries.select("id").collect()):
            others = [j for j in range(120) if j != i and (j > 30) == (i > 30)]
            assert got[i] == sorted(others, key=lambda j: (np.round(np.sqrt(((x[i] - x[j]) ** 2).sum()), 12), j))[:6]
