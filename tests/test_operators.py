"""Properties of the operators on small tables with known answers."""

import pytest
from pyspark.sql import functions as F

from spindrift.functions.stats import average_rank, normal_two_sided, pearson
from spindrift.operators import effects, intervals, matrix, metrics, names, runs, splits, vectors
from spindrift.plans.vectors import dtw
from spindrift.sources.tables import coordinate_matrix, require_columns, require_unique, wide_table

import numpy as np


def test_control_of_the_same_replicate_cancels_shifts(spark):
    rows = [(g, r, "m", v + (100.0 if r == "b" else 0.0) + (2.0 if g == "k" else 0.0), 0.5) for g in ("k", "c") for r in ("a", "b") for v in (1.0, 2.0, 3.0, 4.0)]
    e = effects.group_contrast(spark.createDataFrame(rows, "grp string, replicate string, measure string, value double, cognate double"), "c").collect()
    assert len(e) == 2 and all(abs(x.delta - 2) < 1e-9 and x.n_group == 4 and x.delta_cognate == 0 for x in e)


def test_sufficient_groups_counts_each_replicate(spark):
    rows = [("x", "a")] * 5 + [("x", "b")] * 5 + [("x", "thin")] + [("y", "a")] * 10 + [("y", "b")] * 2 + [("c", "a")] * 9 + [("c", "b")] * 9
    assert [r.grp for r in effects.sufficient_groups(spark.createDataFrame(rows, "grp string, replicate string"), "c", 5, 2).collect()] == ["x"]


def test_bh_is_the_step_up_and_keeps_nulls(spark):
    p = [0.01, 0.04, 0.03, 0.005, None, 0.5]
    got = {r.i: r.q for r in effects.bh_qvalues(spark.createDataFrame(list(enumerate(p)), "i int, p double")).collect()}
    known = sorted((x, i) for i, x in enumerate(p) if x is not None)
    want, low = {}, 1.0
    for rank in range(len(known), 0, -1):
        low = min(low, known[rank - 1][0] * len(known) / rank)
        want[known[rank - 1][1]] = low
    assert got[4] is None and all(abs(got[i] - q) < 1e-12 for i, q in want.items())


def test_normal_tail(spark):
    got = spark.createDataFrame([(0.0,), (1.96,), (-1.96,)], "z double").select(normal_two_sided("z").alias("p")).collect()
    assert abs(got[0].p - 1) < 1e-6 and abs(got[1].p - 0.0499958) < 1e-5 and got[1].p == got[2].p


def test_metrics_of_degenerate_groups_are_null(spark):
    rows = [("one", 1.0, 1.0), ("flat", 1.0, 1.0), ("flat", 1.0, 2.0), ("flat", 1.0, 3.0)] + [("ok", float(i), float(i)) for i in range(5)] + [("ok", None, 3.0)]
    got = {r.g: r for r in metrics.metric_suite(spark.createDataFrame(rows, "g string, predicted double, observed double"), "g").collect()}
    assert got["one"].pearson is None and got["one"].mae is None and got["flat"].spearman is None
    assert got["ok"].n == 5 and abs(got["ok"].spearman - 1) < 1e-12 and got["ok"].nrmse == 0


def test_ranks_and_guarded_correlation(spark):
    df = spark.createDataFrame([(1, 5.0), (1, 5.0), (1, 7.0)], "g int, v double")
    assert sorted(r[0] for r in df.select(average_rank("v", "g")).collect()) == [1.5, 1.5, 3.0]
    assert df.withColumn("c", F.lit(1.0)).groupBy("g").agg(pearson("v", "c").alias("r")).first().r is None


def test_intervals_touching_merge_and_bins_find_each_pair_once(spark):
    iv = spark.createDataFrame([(1, "a", 0, 10), (2, "a", 10, 20), (3, "a", 5, 7), (4, "a", 30, 45), (5, "b", 0, 100), (6, "a", 0, 44)], "id int, chrom string, start long, end long")
    assert {(r.chrom, r.start, r.end, r.n) for r in intervals.merge_union(iv.filter("id < 6")).collect()} == {("a", 0, 20, 3), ("a", 30, 45, 1), ("b", 0, 100, 1)}
    assert sorted((r.id_a, r.id_b) for r in intervals.overlap_pairs(iv, 7, 10.0).collect()) == [(1, 3), (1, 6), (2, 6), (3, 6), (4, 6)]
    by = {}
    for r in intervals.band_pairs(iv, 12, 10.0).collect():
        by[r.id_a] = by.get(r.id_a, 0) + r.weight
    assert all(abs(s - 1) < 1e-9 for s in by.values()) and 5 not in by


def test_splits_are_stable_and_exact(spark):
    ids = spark.createDataFrame([(i, "rare" if i < 18 else "ab"[i % 2]) for i in range(1000)], "id int, s string")
    one = {r.id for r in splits.hash_split(ids, "id", 0.2, 1).filter("selected").collect()}
    half = {r.id for r in splits.hash_split(ids.filter("id % 2 = 0"), "id", 0.2, 1).filter("selected").collect()}
    assert half == {i for i in one if i % 2 == 0} and 120 < len(one) < 280
    got = splits.stratified_split(ids, "id", "s", 0.2, 1).groupBy("s").agg(F.count_if("selected").alias("k")).collect()
    assert {r.s: r.k for r in got}["rare"] == 4
    parts = splits.three_way_split(ids, "id", "s", 0.1, 0.2, 5).groupBy("part").count().collect()
    assert sum(r["count"] for r in parts) == 1000 and len(parts) == 4
    d = [splits.split_digest(x, "id").first().digest for x in (ids, ids.orderBy(F.desc("id")))]
    assert d[0] == d[1]


def test_names(spark):
    n = spark.createDataFrame([(0, "CD-3", 1), (1, "cd3", 1), (2, "nan", 1), (3, None, 1), (4, "X", 2), (5, "x", 1)], "pos int, name string, priority int")
    assert {(r.alias, r.pos) for r in names.alias_lookup(n).collect()} == {("CD3", 0), ("X", 5)}
    ids = spark.createDataFrame([("1",), ("2",)], "id string")
    known = spark.createDataFrame([("a1",), ("b1",)], "id string")
    assert names.best_format(ids, known, [F.concat(F.lit("a"), "id"), F.concat(F.lit("b"), "id")]).first().format == 0


def test_matrix_rules(spark):
    x = spark.createDataFrame([(1, "a", 1.0), (1, "b", 3.0), (2, "a", 1.0)], "row int, col string, value double")
    assert {(r.row, r.col): round(r.value, 4) for r in matrix.minmax(x).collect()} == {(1, "a"): 0.0, (1, "b"): 0.0, (2, "a"): 0.0}
    target = spark.createDataFrame([("b",), ("z",)], "col string")
    assert sorted((r.row, r.col, r.value) for r in matrix.reindex(x, x.select("row").distinct(), target).collect()) == [(1, "b", 3.0), (1, "z", 0.0), (2, "b", 0.0), (2, "z", 0.0)]
    c = spark.createDataFrame([("k", float(i), 3.0 * i + 1, True) for i in range(4)] + [("flat", 1.0, float(i), True) for i in range(3)] + [("k", 9.0, -9.0, False)], "col string, predicted double, observed double, is_control boolean")
    got = {r.col: r for r in matrix.calibration(c).collect()}
    assert abs(got["k"].slope - 3) < 1e-9 and abs(got["k"].scale - 3) < 1e-9 and got["flat"].slope == 1 and got["flat"].scale == 1


def test_runs(spark):
    r = spark.createDataFrame([("base", 1, 1.0), ("base", 2, 2.0), ("x", 1, 0.5), ("x", 2, 2.5), ("y", 1, 0.5), ("y", 2, 2.5)], "arm string, seed int, metric double")
    got = {x.arm: x for x in runs.paired_deltas(r, "arm", ["seed"], "metric", "base").collect()}
    assert got["x"].mean_delta == 0 and got["x"].wins == 1
    assert [(x.arm_a, x.arm_b) for x in runs.duplicate_arms(r, "arm", ["seed"], "metric", 1e-9, 2).collect()] == [("x", "y")]
    ci = runs.bootstrap_mean(spark.createDataFrame([(i, 4.0) for i in range(9)], "u int, v double"), "u", "v", 20, 1).first()
    assert ci.lower == ci.upper == 4.0


def test_vectors_in_blocks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, v[i].tolist()) for i in range(60)], "id long, vec array<float>")
    got = {(r.id, r.neighbour) for r in vectors.nearest(df.filter("id % 20 = 0"), df, 3).collect()}
    want = set()
    for i in (0, 20, 40):
        d = ((v.astype(float) - v[i].astype(float)) ** 2).sum(1)
        d[i] = np.inf
        want |= {(i, int(j)) for j in np.argsort(d)[:3]}
    assert got == want
    same = df.select("id", F.col("vec").alias("a"), F.col("vec").alias("b"), F.lit(0).alias("grp"))
    assert all(r.foscttm == 0 for r in vectors.foscttm(same, same).collect())
    assert dtw(np.array([1.0, 2.0]), np.array([1.0, 2.0])) == 0


def test_sources(spark, tmp_path):
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n%c\n2 3 2\n1 1 5\n2 3 7\n")
    assert sorted(map(tuple, coordinate_matrix(spark, str(tmp_path / "m.mtx")).collect())) == [(0, 0, 5.0), (1, 2, 7.0)]
    (tmp_path / "w.tsv").write_text("gene\tc1\tc2\ng\t1\tx\n")
    assert sorted(map(tuple, wide_table(spark, str(tmp_path / "w.tsv"), "gene").collect()), key=repr) == [("c1", "g", 1.0), ("c2", "g", None)]
    df = spark.createDataFrame([(1,), (1,)], "k int")
    with pytest.raises(ValueError):
        require_unique(df, "k")
    with pytest.raises(ValueError):
        require_columns(df, "z")


def test_numbers_that_follow_the_definitions(spark):
    """Hand-computed values of the measures that once had another definition here."""
    from spindrift.operators import index, metrics, resampling, runs
    from spindrift.plans.fields import reliability

    rel = spark.createDataFrame([(1, 0, 0.0), (2, 0, 1.0), (3, 0, 1.0), (4, 9, 2.0)], "id int, grp int, na double")
    assert {r.id: r.reliability for r in reliability(rel).collect()} == {1: 0.0, 2: 1.0, 3: 1.0, 4: 0.25}
    assert {r.reliability for r in reliability(rel.filter("grp = 9")).collect()} == {0.0}
    curves = [("a", i, v) for i, v in enumerate([9.0, 5.0, 1.4, 1.2, 1.0])] + [("b", 0, 1.0), ("b", 1, 1.0)] + [("c", i, -1.0) for i in range(4)] + [("d", i, 2.0) for i in range(3)]
    got = {r.k: r.settled for r in runs.settling_point(spark.createDataFrame(curves, "k string, t int, v double"), "k", "t", "v", 0.5).collect()}
    assert got == {"a": 2, "b": None, "c": None, "d": 0}
    nan, inf = float("nan"), float("inf")
    p = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0), (nan, 1.0), (1.0, nan), (inf, 1.0), (None, 1.0)], "predicted double, observed double")
    m = metrics.metric_suite(p).first()
    assert (m.n, round(m.pearson, 9), m.mae) == (3, 1.0, 2.0)
    ids = spark.range(50)
    pm = resampling.permuted(ids, "id", 3, 5).collect()
    for b in (1, 2, 3):
        part = [(r.id, r.other) for r in pm if r.b == b]
        assert sorted(x for x, _ in part) == sorted(y for _, y in part) == list(range(50)) and sum(x == y for x, y in part) < 12
    v = spark.createDataFrame([(i, [float(i), 0.0], i % 2) for i in range(8)], "id long, vec array<double>, lst int")
    near = {(r.id, r["rank"]): r.neighbour for r in index.nearest_in_lists(v, v, 2).collect()}
    assert near[0, 1] == 2 and near[0, 2] == 4 and near[3, 1] == 1 and near[3, 2] == 5 and len(near) == 16


def test_index_reaches_its_recall(spark, monkeypatch):
    """Every row is indexed, recall is what brute force says, and a hot list is dealt into tiles without loss."""
    import numpy as np

    from spindrift.operators import index

    monkeypatch.setattr(index, "TILE", 50)
    r = np.random.default_rng(1)
    centres = r.normal(size=(6, 8)) * 3
    x = centres[np.minimum(r.integers(0, 12, 600), 5)] + r.normal(size=(600, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    c, probes, measured = index.calibrated(df, 5, 0.95)
    assert measured >= 0.95 and probes < len(c)
    g = index.search(df, df, c, 5, probes).collect()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    exact = np.argsort(d, axis=1)[:, :5]
    assert len(g) == 3000 and sum(n.neighbour in exact[n.id] for n in g) / 3000 >= 0.9
    assert all(abs(n.distance - d[n.id, n.neighbour]) < 1e-9 for n in g)


def test_far_tails_of_the_normal_distribution(spark):
    import math

    from spindrift.functions.stats import normal_two_sided_log

    zs = [0.0, 0.5, 1.96, 5.0, -8.0, 12.0, 25.0]
    got = spark.createDataFrame([(z,) for z in [*zs, 60.0]], "z double").select(normal_two_sided("z").alias("p"), normal_two_sided_log("z").alias("l")).collect()
    for z, r in zip(zs, got):
        want = math.erfc(abs(z) / math.sqrt(2))
        assert abs(r.p / want - 1) < 3e-7 and abs(r.l - math.log(want)) < 3e-7
    assert -1806 < got[-1].l < -1804
