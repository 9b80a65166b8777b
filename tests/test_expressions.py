"""String and numeric expressions, set operations."""

import pytest
from pyspark.sql import functions as F

from spindrift.functions import maths, strings
from spindrift.operators import sets


def test_settings_and_flags(spark):
    df = spark.createDataFrame([("a=1, b=x=y,junk,a=2",), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(strings.settings(F.col("s"))).collect()] == [{"b": "x=y", "a": "2"}, {}, None]
    t = spark.createDataFrame([("Yes",), ("0",), (" nan ",), (None,)], "s string")
    assert [r[0] for r in t.select(strings.tri_state(F.col("s"))).collect()] == [True, False, None, None]
    with pytest.raises(Exception, match="not a boolean"):
        spark.createDataFrame([("maybe",)], "s string").select(strings.tri_state(F.col("s"))).collect()


def test_site_batch_and_numbers(spark):
    df = spark.createDataFrame([("site1_donor2_cite", "1e3"), ("x", "inf")], "s string, n string")
    a, b = df.select(strings.site_batch(F.col("s")).alias("b"), strings.strict_number(F.col("n")).alias("n")).collect()
    assert a.b.batch == "s1d2" and a.b.assay == "cite" and a.n == 1000.0 and b.n is None


def test_interpolation_is_clamped(spark):
    df = spark.createDataFrame([(-1.0,), (0.5,), (9.0,), (None,)], "x double")
    assert [r[0] for r in df.select(maths.interpolated(F.col("x"), [(0, 1), (1, 3)])).collect()] == [1.0, 2.0, 3.0, None]


def test_sets(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(2, 5)], "k int, w int")
    assert {tuple(r) for r in sets.upsert(a, b, ["k"]).collect()} == {(1, "x", None), (2, None, 5)}
    assert [tuple(r) for r in sets.key_differences(a, b, ["k"]).collect()] == [(1, "left")]
    with pytest.raises(ValueError):
        sets.require_disjoint(a, b, ["k"])
    f = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (float("inf"),)], "x double")
    assert sets.finite_rows(f, "x").count() == 1
    assert sets.first_occurrences(a.union(a), "k", "v").filter("is_first").count() == 2
    small, large = ({r.k for r in sets.nested_subset(spark.range(50).withColumnRenamed("id", "k"), "k", n, 3).collect()} for n in (5, 20))
    assert small < large
