"""Entropic optimal transport between the two sides of each group, iterated as Spark jobs over blocks.

The points of a side are packed into blocks, as one array of numbers each, in the type they came in. A list of pairs of blocks, by number alone, is joined to
the packed points, so that a group that holds a third of all points is spread over many tasks; a task holds two blocks. The
potentials of both sides are tables with one array a block, renewed in turn by log-sums over the other side's blocks; a round is a job.
Costs are squared distances over their median in the group, found exactly to rounding by histograms that are refined four times.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import drop_table, write_table

#: Points of a block, and of these whose costs to another block stand in memory at once. The bytes that two sides of n points
#: move in a round are n * n / BLOCK vectors.
BLOCK, CHUNK = 4096, 256
#: Bins and rounds of the median's histograms: the last bins are 2 ** -48 of the range.
BINS, REFINED = 4096, 4
NO_COLUMNS = "array<double>"


class Plan(NamedTuple):
    """A solved transport: blocks of both sides, their potentials over epsilon, the costs' scale, epsilon."""

    a: DataFrame
    b: DataFrame
    f: DataFrame
    g: DataFrame
    scale: DataFrame
    epsilon: float


def blocked(points: DataFrame, side: str) -> DataFrame:
    """One row per block of a group: ids, vectors and payloads as flat arrays, in one order."""
    x = points.filter(F.col("side") == side)
    load = F.col("payload") if "payload" in points.columns else F.array().cast(NO_COLUMNS)
    n = x.groupBy("grp").agg(F.count("*").alias("n"))
    x = x.join(n, "grp").withColumn("block", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / BLOCK)).cast("int"))
    rows = x.groupBy("grp", "block", "n").agg(F.sort_array(F.collect_list(F.struct("id", "vec", load.cast(NO_COLUMNS).alias("payload")))).alias("p"))
    return rows.select("grp", "block", "n", F.col("p.id").alias("ids"), F.flatten("p.vec").alias("flat"), F.flatten("p.payload").alias("load"))


def costs(p_flat, p_n: int, q_flat, q_n: int, scale: float) -> Iterator[tuple[slice, np.ndarray]]:
    """Squared distances over the scale, ``CHUNK`` rows of the first block at a time."""
    p, q = (np.reshape(np.asarray(flat, np.float64), (n, -1)) for flat, n in ((p_flat, p_n), (q_flat, q_n)))
    square = (q**2).sum(1)[None]
    for first in range(0, len(p), CHUNK):
        part = slice(first, min(first + CHUNK, len(p)))
        x = p[part]
        yield part, np.maximum((x**2).sum(1)[:, None] + square - 2 * x @ q.T, 0.0) / scale


def one_row(frames: list[pd.DataFrame]) -> pd.DataFrame:
    """Parts of a block's arrays, end to end in one row; other columns from the first part."""
    arrays = {c for c in frames[0] if isinstance(frames[0][c][0], np.ndarray)}
    return pd.DataFrame({c: [np.concatenate([f[c][0] for f in frames])] if c in arrays else [frames[0][c][0]] for c in frames[0]})


def summed(*keys: str) -> Callable[[list[pd.DataFrame]], pd.DataFrame]:
    return lambda frames: pd.concat(frames).groupby(list(keys), as_index=False).sum()


def meet(a: DataFrame, b: DataFrame, extra: DataFrame | None, scale: DataFrame, kernel: Callable, schema: str, merged: Callable = pd.concat) -> DataFrame:
    """``kernel(row, part, cost)`` of the parts of every two blocks of a group, ``merged`` for the pair; ``extra`` has further columns by (grp, block) of ``b``."""
    pairs = a.select("grp", F.col("block").alias("i")).join(b.select("grp", F.col("block").alias("j")), "grp")  # numbers only
    left = a.select("grp", F.col("block").alias("i"), F.col("n").alias("np"), F.col("ids").alias("p_ids"), F.col("flat").alias("p_flat"))
    right = b.select("grp", F.col("block").alias("j"), F.col("n").alias("nq"), F.col("ids").alias("q_ids"), F.col("flat").alias("q_flat"), F.col("load").alias("q_load"))
    if extra is not None:
        right = right.join(extra.withColumnRenamed("block", "j"), ["grp", "j"])
    both = pairs.join(left, ["grp", "i"]).join(right, ["grp", "j"]).join(scale, "grp")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                yield merged([kernel(r, part, cost) for part, cost in costs(r.p_flat, len(r.p_ids), r.q_flat, len(r.q_ids), r.scale)])

    return both.mapInPandas(run, schema)


def median_costs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(grp, scale): lower median of the squared distances between the sides, 1 where that is 0."""
    one = a.select("grp").distinct().join(b.select("grp").distinct(), "grp").withColumn("scale", F.lit(1.0))

    def extremes(r, part, cost):
        return pd.DataFrame({"grp": [r.grp], "low": [cost.min()], "high": [cost.max()], "n": [cost.size]})

    span = meet(a, b, None, one, extremes, "grp int, low double, high double, n long").groupBy("grp").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))
    # rank (from 0) of the lower median, and how many costs lie below the range
    span = write_table(span.select("grp", "low", "high", F.floor((F.col("n") - 1) / 2).alias("rank"), F.lit(0).cast("long").alias("below"), F.lit(1.0).alias("scale")), "transport-median")

    def binned(r, part, cost):
        c = cost.ravel()
        at = np.clip(np.floor((c - r.low) / max(r.high - r.low, 1e-300) * BINS), 0, BINS - 1).astype(int)[(c >= r.low) & (c <= r.high)]
        n = np.bincount(at, minlength=BINS)
        hit = np.flatnonzero(n)
        return pd.DataFrame({"grp": r.grp, "bin": hit, "n": n[hit]})

    for _ in range(REFINED):
        n = meet(a, b, None, span, binned, "grp int, bin long, n long", summed("grp", "bin")).groupBy("grp", "bin").agg(F.sum("n").alias("n"))
        # at most BINS rows a group
        bins = n.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("bins")).join(span, "grp")
        start = F.struct(F.col("below").alias("upto"), F.lit(-1).cast("long").alias("bin"), F.lit(0).cast("long").alias("before"))
        step = lambda s, x: F.when((s.bin < 0) & (s.upto + x.n > F.col("rank")), F.struct((s.upto + x.n).alias("upto"), x.bin.alias("bin"), s.upto.alias("before"))).otherwise(F.struct((s.upto + x.n).alias("upto"), s.bin.alias("bin"), s.before.alias("before")))
        width = (F.col("high") - F.col("low")) / BINS
        found = bins.select("grp", "low", "high", "rank", "scale", F.aggregate("bins", start, step).alias("s"))
        new = write_table(found.select("grp", (F.col("low") + F.col("s.bin") * width).alias("low"), (F.col("low") + (F.col("s.bin") + 1) * width).alias("high"), "rank", F.col("s.before").alias("below"), "scale"), "transport-median")
        drop_table(span)
        span = new
    middle = (F.col("low") + F.col("high")) / 2
    return span.select("grp", F.when(middle > 1e-12, middle).otherwise(1.0).alias("scale"))


def sinkhorn(points: DataFrame, epsilon: float = 0.05, iterations: int = 50, scaled: bool = True, penalty: float | None = None) -> Plan:
    """Potentials of the entropic plan with uniform margins, per group of (grp, id, side 'a'|'b', vec[, payload]).

    ``scaled`` divides costs by their median. With a ``penalty`` the margins need not hold: each costs its divergence from the
    uniform one times the penalty, so that points without a near partner give up mass. Groups that lack a side are left out."""
    held = 1.0 if penalty is None else penalty / (penalty + epsilon)
    a, b = (write_table(blocked(points, s), f"transport-{s}") for s in "ab")
    one = a.select("grp").distinct().join(b.select("grp").distinct(), "grp").withColumn("scale", F.lit(1.0))
    scale = write_table(median_costs(a, b) if scaled else one, "transport-scale")

    def soft(r, part, cost):
        k = np.asarray(r.v)[None] - cost / epsilon
        top = k.max(1)
        return pd.DataFrame({"grp": [r.grp], "block": [r.i], "n": [r.np], "top": [top], "total": [np.exp(k - top[:, None]).sum(1)]})

    def renewed(x: DataFrame, y: DataFrame, potential: DataFrame) -> DataFrame:
        """One array of potentials a block, log-summed over all blocks of the other side."""
        parts = meet(x, y, potential, scale, soft, "grp int, block int, n long, top array<double>, total array<double>", one_row)
        cells = parts.select("grp", "block", "n", F.inline(F.arrays_zip(F.sequence(F.lit(0), F.size("top") - 1).alias("at"), "top", "total")))
        cells = cells.toDF("grp", "block", "n", "at", "top", "total")
        s = cells.groupBy("grp", "block", "n", "at").agg(F.max("top").alias("most"), F.collect_list(F.struct("top", "total")).alias("parts"))
        log_sum = F.col("most") + F.log(F.aggregate("parts", F.lit(0.0), lambda z, p: z + p.total * F.exp(p.top - F.col("most"))))
        v = s.select("grp", "block", "at", (-F.log(F.col("n").cast("double")) - held * log_sum).alias("v"))
        return v.groupBy("grp", "block").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "v"))), lambda z: z.v).alias("v"))

    g = write_table(b.select("grp", "block", F.array_repeat(F.lit(0.0), F.size("ids")).alias("v")), "transport-potential")
    f = None
    for _ in range(iterations):
        old = (f, g)
        f = write_table(renewed(a, b, g), "transport-potential")
        g = write_table(renewed(b, a, f), "transport-potential")
        for x in old:
            if x is not None:
                drop_table(x)
    return Plan(a, b, f, g, scale, epsilon)


def rows_of(plan: Plan) -> DataFrame:
    """Per ``a`` point (grp, src): its best partner dst (ties: the smallest id) and that one's share of its mass, its mass, the
    entropy of its row, the confidence 1 - entropy / log(partners) within 0 and 1, and the mean of the partners' payloads."""
    epsilon = plan.epsilon

    def best_partners(r, part, cost):
        k = np.asarray(r.v)[None] - cost / epsilon
        top, at = k.max(1), k.argmax(1)
        e = np.exp(k - top[:, None])
        load = np.reshape(r.q_load, (len(r.q_ids), -1))
        return pd.DataFrame({"grp": r.grp, "i": r.i, "at": np.arange(part.start, part.stop), "src": r.p_ids[part], "n": r.nq, "dst": np.asarray(r.q_ids)[at], "top": top, "s": e.sum(1), "h": (e * (k - top[:, None])).sum(1), "load": list(e @ load)})

    parts = meet(plan.a, plan.b, plan.g, plan.scale, best_partners, "grp int, i int, at int, src long, n long, dst long, top double, s double, h double, load array<double>")
    own = plan.f.select("grp", F.col("block").alias("i"), F.posexplode("v").alias("at", "fv"))
    best = parts.groupBy("grp", "i", "at", "src", "n").agg(F.max(F.struct("top", (-F.col("dst")).alias("d"))).alias("m"), F.collect_list(F.struct("top", "s", "h", "load")).alias("parts"))
    weight = lambda p: F.exp(p.top - F.col("m.top"))
    s = F.aggregate("parts", F.lit(0.0), lambda z, p: z + p.s * weight(p))
    h = F.aggregate("parts", F.lit(0.0), lambda z, p: z + (p.h + (p.top - F.col("m.top")) * p.s) * weight(p))
    zero = F.transform(F.col("parts")[0].load, lambda x: F.lit(0.0))
    load = F.aggregate("parts", zero, lambda z, p: F.zip_with(z, F.transform(p.load, lambda x: x * weight(p)), lambda x, y: x + y))
    summed = best.join(own, ["grp", "i", "at"]).select("grp", "src", "n", (-F.col("m.d")).alias("dst"), s.alias("s"), h.alias("h"), load.alias("load"), (F.col("fv") + F.col("m.top")).alias("log_mass"))
    entropy = F.log("s") - F.col("h") / F.col("s")
    confidence = F.when(F.col("n") > 1, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - entropy / F.log(F.col("n").cast("double"))))).otherwise(0.0)
    return summed.select("grp", "src", "dst", (1 / F.col("s")).alias("share"), (F.exp("log_mass") * F.col("s")).alias("mass"), entropy.alias("entropy"), confidence.alias("confidence"), F.transform("load", lambda x: x / F.col("s")).alias("projected"))


def retrieval(plan: Plan, depths: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Per group with equal ids on both sides: how the true partner ranks by transported mass, averaged over both sides, as
    foscttm and the shares of ranks below each depth."""
    epsilon = plan.epsilon
    vecs = []
    for side, pot in ((plan.a, plan.f), (plan.b, plan.g)):
        n = F.size("ids")
        rows = side.join(pot, ["grp", "block"]).select("grp", "n", "flat", F.posexplode("ids").alias("at", "id"), "v", n.alias("m"))
        width = (F.size("flat") / F.col("m")).cast("int")
        vecs.append(rows.select("grp", "n", "id", F.slice("flat", F.col("at") * width + 1, width).cast(NO_COLUMNS).alias("x"), F.col("v")[F.col("at")].alias("pot")))
    a, b = vecs
    square = F.aggregate(F.zip_with("x", "y", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    own = a.join(b.select("grp", "id", F.col("x").alias("y"), F.col("pot").alias("pot2")), ["grp", "id"]).join(plan.scale, "grp")
    truth = write_table(own.select("grp", "id", (F.col("pot") + F.col("pot2") - square / F.col("scale") / epsilon).alias("t")), "transport-truth")

    def ranked(x: DataFrame, y: DataFrame, px: DataFrame, py: DataFrame) -> DataFrame:
        mine = x.join(px, ["grp", "block"]).select("grp", "block", F.posexplode("ids").alias("at", "id"), F.col("v"))
        mine = mine.select("grp", "block", "at", "id", F.col("v")[F.col("at")].alias("u")).join(truth, ["grp", "id"])
        packed = mine.groupBy("grp", "block").agg(F.sort_array(F.collect_list(F.struct("at", "id", (F.col("t") - F.col("u")).alias("t")))).alias("z"))
        marked = x.join(packed, ["grp", "block"]).withColumn("load", F.col("z.t")).drop("z")

        def above(r, part, cost):  # rows: y's points; columns: x's, whose truths are their load
            k = np.asarray(r.v)[part, None] - cost / epsilon
            return pd.DataFrame({"grp": r.grp, "id": r.q_ids, "n": r.nq, "above": (k > np.asarray(r.q_load)[None] + 1e-9).sum(0)})

        with_v = y.join(py, ["grp", "block"])
        pairs = meet_with(with_v, marked, plan.scale, above)
        return pairs.groupBy("grp", "id", "n").agg(F.sum("above").alias("rank"))

    ranks = ranked(plan.a, plan.b, plan.f, plan.g).unionByName(ranked(plan.b, plan.a, plan.g, plan.f))
    shares = [F.avg((F.col("rank") < F.least(F.lit(d), F.col("n"))).cast("double")).alias(f"top{d}") for d in depths]
    return ranks.filter("n > 1").groupBy("grp").agg(F.avg(F.col("rank") / (F.col("n") - 1)).alias("foscttm"), *shares)


def meet_with(a: DataFrame, b: DataFrame, scale: DataFrame, kernel: Callable) -> DataFrame:
    """``meet`` with the potentials ``v`` of the first side's points."""
    pots = a.select("grp", F.col("block").alias("i"), "v")
    left = a.drop("v")
    pairs = left.select("grp", F.col("block").alias("i")).join(b.select("grp", F.col("block").alias("j")), "grp")
    p = left.select("grp", F.col("block").alias("i"), F.col("ids").alias("p_ids"), F.col("flat").alias("p_flat")).join(pots, ["grp", "i"])
    q = b.select("grp", F.col("block").alias("j"), F.col("n").alias("nq"), F.col("ids").alias("q_ids"), F.col("flat").alias("q_flat"), F.col("load").alias("q_load"))
    both = pairs.join(p, ["grp", "i"]).join(q, ["grp", "j"]).join(scale, "grp")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                yield summed("grp", "id", "n")([kernel(r, part, cost) for part, cost in costs(r.p_flat, len(r.p_ids), r.q_flat, len(r.q_ids), r.scale)])

    return both.mapInPandas(run, "grp int, id long, n long, above long")


def divergence(points: DataFrame, epsilon: float, iterations: int = 50) -> DataFrame:
    """(grp, divergence): OT(a, b) - OT(a, a) / 2 - OT(b, b) / 2 of the entropic costs, by their dual values, unscaled."""

    def value(x: DataFrame, name: str) -> DataFrame:
        plan = sinkhorn(x, epsilon, iterations, scaled=False)
        # epsilon times the potentials, each margin uniform; log margins were taken off in the updates
        sums = [p.select("grp", F.explode("v").alias("v")).groupBy("grp").agg((epsilon * F.avg(F.col("v"))).alias(f"{name}{k}"), F.count("*").alias(f"n{name}{k}")) for k, p in enumerate((plan.f, plan.g))]
        both = sums[0].join(sums[1], "grp")
        logs = epsilon * (F.log(F.col(f"n{name}0").cast("double")) + F.log(F.col(f"n{name}1").cast("double")))
        return both.select("grp", (F.col(f"{name}0") + F.col(f"{name}1") + logs).alias(name))

    def twice(side: str) -> DataFrame:
        one = points.filter(F.col("side") == side)
        return one.withColumn("side", F.lit("a")).unionByName(one.withColumn("side", F.lit("b")))

    parts = value(points, "ab").join(value(twice("a"), "aa"), "grp").join(value(twice("b"), "bb"), "grp")
    return parts.select("grp", (F.col("ab") - F.col("aa") / 2 - F.col("bb") / 2).alias("divergence"))
