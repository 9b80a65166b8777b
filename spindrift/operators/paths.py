"""Paths integrated in order, row by row of a sorted stream: a task holds one key's last state, never its history."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def integrate(df: DataFrame, key: str, time: str, drive: str, gain: str, rate: str, decay: float, start: float = 0.0, lag: float = 0.0) -> DataFrame:
    """Add ``level`` to (key, time, drive, gain, rate): p' = rate (gain drive(t - lag) - decay p) by Runge-Kutta steps of order
    four from each row of a key to the next, the columns linear in between; p is ``start`` at the first row and never below 0.

    With a ``lag``, a task also holds the drive of that stretch of time; before a key's first row its first drive counts. Rows
    with a null time, drive, gain or rate are left out; rows of equal time keep the level."""
    names = [key, time, drive, gain, rate]
    x = df.select(key, *(F.col(c).cast("double").alias(c) for c in names[1:])).dropna(subset=names[1:])
    ordered = x.repartition(key).sortWithinPartitions(*names)
    schema = f"{key} {df.schema[key].dataType.simpleString()}, {time} double, level double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, past = None, deque()
        t0 = s0 = a0 = k0 = p = 0.0

        def delayed(t: float) -> float:
            """Drive at a time not after the newest point of ``past``; points that are no longer needed are dropped."""
            while len(past) > 1 and past[1][0] <= t:
                past.popleft()
            (t1, v1) = past[0]
            if t <= t1 or len(past) == 1:
                return v1
            t2, v2 = past[1]
            return v1 + (v2 - v1) * (t - t1) / (t2 - t1)

        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                k, t, s, a, r = row
                if now is None or k != now[0]:
                    now, p = (k,), start
                    past = deque([(t, s)])
                else:
                    h = t - t0
                    past.append((t, s))
                    s_0, s_mid, s_1 = (s0, (s0 + s) / 2, s) if lag == 0 else (delayed(t0 - lag), delayed(t0 + h / 2 - lag), delayed(t - lag))
                    if lag == 0:
                        past.popleft()
                    a_mid, k_mid = (a0 + a) / 2, (k0 + r) / 2
                    k1 = k0 * (a0 * s_0 - decay * p)
                    k2 = k_mid * (a_mid * s_mid - decay * (p + h / 2 * k1))
                    k3 = k_mid * (a_mid * s_mid - decay * (p + h / 2 * k2))
                    k4 = r * (a * s_1 - decay * (p + h * k3))
                    p = max(0.0, p + h * (k1 + 2 * k2 + 2 * k3 + k4) / 6)
                t0, s0, a0, k0 = t, s, a, r
                out.append((k, t, p))
            yield pd.DataFrame(out, columns=[key, time, "level"])

    return ordered.mapInPandas(run, schema)


def stopped(df: DataFrame, key: str, order: str, value: Column, patience: int) -> DataFrame:
    """Per key: the step (from 1) at which ``patience`` steps have gone by without a new least value, or null; the best step
    and value until then. Null values are no improvement."""
    o = W.partitionBy(key).orderBy(order)
    upto = o.rowsBetween(W.unboundedPreceding, -1)
    x = df.select(key, order, value.alias("_v")).withColumns({"_k": F.row_number().over(o), "_least": F.min("_v").over(upto)})
    better = F.col("_v").isNotNull() & (F.col("_least").isNull() | (F.col("_v") < F.col("_least")))
    x = x.withColumn("_last", F.coalesce(F.max(F.when(better, F.col("_k"))).over(o.rowsBetween(W.unboundedPreceding, 0)), F.lit(0)))
    stop = x.groupBy(key).agg(F.min(F.when(F.col("_k") - F.col("_last") >= patience, F.col("_k"))).alias("stop"))
    seen = x.join(stop, key).filter(F.col("stop").isNull() | (F.col("_k") <= F.col("stop")))
    return seen.groupBy(key).agg(F.max("stop").alias("stop"), F.max("_last").alias("best"), F.min("_v").alias("value"))
