"""Exact quantiles whose cuts are merged once, so that all who read them see the same ones."""

import numpy as np
import pytest

from spindrift.operators import profiles


@pytest.mark.parametrize("by", [["g"], []])
def test_cuts_are_merged_once(spark, by):
    x = np.random.default_rng(11).integers(0, 400, 3000) / 4
    df = spark.createDataFrame([(int(i % 2), float(v)) for i, v in enumerate(x)], "g int, v double")
    shares = tuple((i + 0.5) / 50 for i in range(50))
    q = profiles.exact_quantiles(df, by, "v", shares, buckets=20)
    assert "percentile_approx" not in q._jdf.queryExecution().optimizedPlan().toString()
    got = q.collect()
    assert len(got) == 50 * (2 if by else 1)
    for r in got:
        assert abs(r.quantile - np.quantile(x[r.g :: 2] if by else x, r.share)) < 1e-9
