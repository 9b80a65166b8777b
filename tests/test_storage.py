"""Sinks that commit whole tables, and the routed stream."""

import pytest
from pyspark.sql import functions as F

from spindrift.sources import sinks
from spindrift.sources.shared import shared_dir
from spindrift.streaming import matrices


def values(df):
    return sorted(map(tuple, df.collect()))


def test_publish_refuses_other_provenance_and_frozen_tables(spark):
    folder = shared_dir(spark, "test-publish")
    one, two = spark.createDataFrame([(1, "a")], "k int, v string"), spark.createDataFrame([(2, None)], "k int, v string")
    assert sinks.marker(spark, folder) is None and not sinks.validate(spark, folder)
    with pytest.raises(FileNotFoundError):
        sinks.read_published(spark, folder)
    assert values(sinks.publish(one, folder, {"source": "x", "n": 3})) == [(1, "a")] and sinks.validate(spark, folder)
    with pytest.raises(sinks.ProvenanceError, match="n: 3 -> 4"):
        sinks.publish(two, folder, {"source": "x", "n": 4})
    assert values(sinks.read_published(spark, folder)) == [(1, "a")]
    assert values(sinks.publish(two, folder, {"source": "x", "n": 4}, force=True, frozen=True)) == [(2, None)]
    with pytest.raises(sinks.ProvenanceError, match="frozen"):
        sinks.publish(one, folder, {"source": "x", "n": 4}, force=True)
    assert values(sinks.publish(one.limit(0), shared_dir(spark, "test-empty"), {})) == []


def test_a_broken_attempt_changes_nothing(spark):
    folder = shared_dir(spark, "test-broken")
    sinks.publish(spark.range(5), folder, {"n": 5})
    bad = spark.range(9).select(F.when(F.col("id") == 8, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="lost"):
        sinks.publish(bad, folder, {"n": 5})
    assert sinks.validate(spark, folder) and values(sinks.read_published(spark, folder)) == [(i,) for i in range(5)]
    spark.range(3).write.parquet(f"{folder}/part-leftover")
    sinks.publish(spark.range(2), folder, {"n": 5})
    fs, path = sinks._fs(spark, folder)
    assert not fs.exists(path(f"{folder}/part-leftover")) and values(sinks.read_published(spark, folder)) == [(0,), (1,)]


def test_resume_computes_what_is_missing(spark):
    folder, seen = shared_dir(spark, "test-resume"), []

    def work(df):
        seen.append(sorted(r.k for r in df.select("k").distinct().collect()))
        return df.groupBy("k").agg(F.sum("v").alias("s"))

    df = spark.createDataFrame([(k, v) for k in range(6) for v in (1, 10)], "k int, v int")
    for part in (df.filter("k < 2"), df, df):
        got = values(sinks.resume(part, folder, ["k"], work, {"v": 1}))
    assert got == [(k, 11) for k in range(6)] and seen == [[0, 1], [2, 3, 4, 5]]
    assert len(sinks.marker(spark, folder)["parts"]) == 2
    with pytest.raises(sinks.ProvenanceError):
        sinks.resume(df, folder, ["k"], work, {"v": 2})


def test_routed_blocks_count_once(spark):
    folder = shared_dir(spark, "test-blocks")
    x = [(i % 7, i % 3, float(i)) for i in range(100)]
    matrices.write_blocks(spark.createDataFrame(x, "row long, col long, value double"), folder, 5)
    routes = [("even", r, r // 2) for r in range(0, 7, 2)] + [("all", r, 0) for r in range(7)]
    got, entries = matrices.routed(spark, folder, spark.createDataFrame(routes, "output string, row long, target long"), files=2)
    want = {}
    for o, r, t in routes:
        for row, col, v in x:
            if row == r:
                want[o, t, col] = want.get((o, t, col), 0) + v
    assert {(g.output, g.target, g.col): g.value for g in got.collect()} == want and entries.first().entries == 100


def test_written_tables_can_be_cleared(spark):
    from spindrift.sources import shared

    shared.clear_written(spark)
    one, two = (shared.write_table(spark.range(3), "test-clear") for _ in range(2))
    shared.drop_table(one)
    assert two.count() == 3 and len(shared._written) <= 2
    assert shared.clear_written(spark) >= 1 and not shared._written
    with pytest.raises(Exception, match="FAILED_READ_FILE|does not exist|No such file"):
        two.count()
