"""Graphs as edge tables (src, dst[, weight])."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import append_table, drop_table, shared_dir, write_table
from . import ranks

#: Tasks that the nodes of one label are dealt over.
SALTS = 32
#: Words of 64 sources in a row of the search for hops.
WORDS = 4


def both_ways(edges: DataFrame) -> DataFrame:
    """Edges and their reverses, of one reading of ``edges``: what it takes to compute them is done once."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    ways = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return edges.select(F.explode(ways).alias("_e"), *rest).select("_e.src", "_e.dst", *rest)


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """(node, component): the smallest node reachable. Every round each node takes the smallest label around it and
    then the label of its label, so long chains settle in a few rounds; rounds are written, not collected."""
    both = write_table(both_ways(edges.select("src", "dst")).distinct(), "graph-edges")
    label = both.groupBy(F.col("src").alias("node")).agg(F.least(F.col("node"), F.min("dst")).alias("component"))
    label = write_table(label, "graph-labels")
    for _ in range(rounds):
        near = both.join(label.select(F.col("node").alias("dst"), "component"), "dst").groupBy("src").agg(F.min("component").alias("near"))
        step = label.join(near.withColumnRenamed("src", "node"), "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        # most nodes may share one label: the labels in use stand once a salt, and a label's nodes are dealt over the salts
        used = step.groupBy("component").agg(F.lit(1).alias("_u")).select("component")
        up = step.select(F.col("node").alias("component"), F.col("component").alias("up")).join(used, "component", "left_semi")
        up = up.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = step.withColumn("_salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
        new = write_table(salted.join(up, ["component", "_salt"]).select("node", "old", F.least("component", "up").alias("component")), "graph-labels")
        moved = new.filter("component <> old").limit(1).count()
        drop_table(label)
        label = new.select("node", "component")
        if not moved:
            drop_table(both)
            return label
    raise ValueError("components did not settle")


def stitched(full: DataFrame, control: DataFrame, fit: DataFrame) -> DataFrame:
    """Edges of two neighbour graphs by row: control rows take theirs from the control graph only, all other rows from
    the full graph. ``fit`` has (row, is_control)."""
    c = fit.filter("is_control").select(F.col("row").alias("src"))
    inner = control.join(c, "src", "left_semi").join(c.withColumnRenamed("src", "dst"), "dst", "left_semi")
    return full.join(c, "src", "left_anti").select("src", "dst", "weight").union(inner.select("src", "dst", "weight"))


def geodesics(edges: DataFrame, sources: DataFrame, weight: str | None = None, within: str | None = None) -> DataFrame:
    """(source, node, distance): shortest ways from every row of ``sources`` (source) to all nodes it reaches, both ways along
    (src, dst); hops, or sums of the positive ``weight``. Each round only nodes that have become nearer pass on their
    distance; no round holds more than a row per source and node. Hops are counted for a block of up to 64 * ``WORDS`` sources
    at once, a bit each; blocks are filled in order of ``within``, a column of ``sources`` that is best equal for sources that
    reach the same nodes (the result does not depend on it)."""
    if weight is None:
        return _hops(edges, sources, within)
    e = edges.select("src", "dst", F.col(weight).cast("double").alias("w"))
    both = write_table(both_ways(e).groupBy("src", "dst").agg(F.min("w").alias("w")), "geodesic-edges")
    known = write_table(sources.select("source", F.col("source").alias("node"), F.lit(0.0).alias("distance"), F.lit(True).alias("new")).distinct(), "geodesics")
    while True:
        step = known.filter("new").join(both, known.node == both.src).select("source", F.col("dst").alias("node"), (F.col("distance") + F.col("w")).alias("distance"))
        offered = step.groupBy("source", "node").agg(F.min("distance").alias("offer"))
        met = known.drop("new").join(offered, ["source", "node"], "full_outer")
        nearer = F.col("distance").isNull() | (F.col("offer") < F.col("distance"))
        after = write_table(met.select("source", "node", F.least("distance", "offer").alias("distance"), F.coalesce(nearer, F.lit(False)).alias("new")), "geodesics")
        drop_table(known)
        known = after
        if not known.filter("new").limit(1).count():
            drop_table(both)
            return known.drop("new")


def _hops(edges: DataFrame, sources: DataFrame, within: str | None) -> DataFrame:
    """``geodesics`` without weights. A row (block, node) has a bit for each source of the block, in words: seen so far (s), and
    first seen in this round (f); the latter are written with the round's number and joined to their sources in the end."""
    both = write_table(both_ways(edges.select("src", "dst")).distinct(), "geodesic-edges")
    asked = sources.groupBy("source").agg((F.min(within) if within else F.lit(0)).alias("_w"))
    words, zero = range(WORDS), F.lit(0).cast("long")
    seen, fresh = [F.col(f"s{j}") for j in words], [F.col(f"f{j}") for j in words]
    some = reduce(or_, (f != 0 for f in fresh))

    place = ranks.numbered(asked, F.col("_w"), F.col("source"), out="_n").withColumn("_n", F.col("_n") - 1)
    bit = F.expr("shiftleft(1L, cast(_n % 64 as int))")
    masks = (F.when(F.floor(F.col("_n") / 64) % WORDS == j, bit).otherwise(zero).alias(f"m{j}") for j in words)
    place = write_table(place.select(F.floor(F.col("_n") / (64 * WORDS)).alias("block"), "source", *masks), "geodesic-sources")
    known = write_table(place.select("block", F.col("source").alias("node"), *(F.col(f"m{j}").alias(f"{c}{j}") for c in "sf" for j in words)), "geodesics")
    path, distance = shared_dir(known.sparkSession, "geodesic-rounds"), 0
    while True:
        found = known.filter(some).select("block", "node", *fresh, F.lit(float(distance)).alias("distance"))
        append_table(found, path)
        if not known.filter(some).limit(1).count():
            drop_table(both)
            drop_table(known)
            rounds = known.sparkSession.read.schema(found.schema).parquet(path)
            hit = reduce(or_, (f.bitwiseAND(F.col(f"m{j}")) != 0 for j, f in zip(words, fresh)))
            return rounds.join(place, (rounds.block == place.block) & hit).select("source", "node", "distance")
        sent = known.filter(some).join(both, F.col("node") == F.col("src")).select("block", F.col("dst").alias("node"), *(zero.alias(f"s{j}") for j in words), *fresh)
        kept = known.select("block", "node", *seen, *(zero.alias(f"f{j}") for j in words))
        met = kept.union(sent).groupBy("block", "node").agg(*(F.bit_or(f"{c}{j}").alias(f"{c}{j}") for c in "sf" for j in words))
        step = met.select("block", "node", *(s.bitwiseOR(f).alias(f"s{j}") for j, (s, f) in enumerate(zip(seen, fresh))), *(f.bitwiseAND(F.bitwise_not(s)).alias(f"f{j}") for j, (s, f) in enumerate(zip(seen, fresh))))
        after = write_table(step, "geodesics")
        drop_table(known)
        known, distance = after, distance + 1
