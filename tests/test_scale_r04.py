"""Steps whose work was repeated, or sorted more than is asked: same results."""

import numpy as np
import pytest

from spindrift.operators import index


@pytest.mark.parametrize("probes", [1, 3, 16, 40])
def test_nearest_lists_equal_a_stable_sort(probes, monkeypatch):
    monkeypatch.setattr(index, "ROWS", 7)
    r = np.random.default_rng(4)
    x, c = (r.integers(0, 3, (n, 4)).astype(float) for n in (30, 16))  # many ties
    c[5] = np.nan
    d = (c**2).sum(1) - 2 * x @ c.T
    assert np.array_equal(index.nearest_lists(x, c, probes), np.argsort(d, axis=1, kind="stable")[:, :probes])


def test_calibration_packs_all_rows_once(spark, monkeypatch):
    packed, real = [], index.tiles

    def counted(points, tile, prefix):
        packed.append(prefix)
        return real(points, tile, prefix)

    monkeypatch.setattr(index, "tiles", counted)
    x = np.random.default_rng(5).normal(size=(400, 12))
    points = spark.createDataFrame([(i, [float(t) for t in v]) for i, v in enumerate(x)], "id long, vec array<float>")
    _, probes, got = index.calibrated(points, 5)
    assert got >= 0.95 and probes >= 4 and packed.count("m") == 2  # brute force, and the lists for all rounds
