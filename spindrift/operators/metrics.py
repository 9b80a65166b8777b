"""Agreement of predicted and observed columns, over groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import average_rank, pearson, ratio


def metric_suite(df: DataFrame, *by: str, predicted: str = "predicted", observed: str = "observed") -> DataFrame:
    """n, Spearman, Pearson, MAE, NRMSE (over the population deviation of observed) and sign accuracy per group.

    Rows with a side that is null, NaN or infinite don't count; groups of fewer than three rows and constant sides give nulls.
    """
    finite = lambda c: F.abs(F.col(c).cast("double")) < float("inf")  # noqa: E731  NaN is above infinity
    x = df.filter(finite(predicted) & finite(observed)).withColumns({"_p": F.col(predicted), "_o": F.col(observed)})
    x = x.withColumns({"_rp": average_rank("_p", *by), "_ro": average_rank("_o", *by)})
    err = F.col("_p") - F.col("_o")
    enough = F.count("*") >= 3
    return x.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.when(enough, pearson("_rp", "_ro")).alias("spearman"),
        F.when(enough, pearson("_p", "_o")).alias("pearson"),
        F.when(enough, F.avg(F.abs(err))).alias("mae"),
        F.when(enough, ratio(F.sqrt(F.avg(err * err)), F.stddev_pop("_o"))).alias("nrmse"),
        F.when(enough, F.avg((F.signum("_p") == F.signum("_o")).cast("double"))).alias("sign_accuracy"),
    )


def response_cosine(df: DataFrame, by: str, predicted: str = "predicted", observed: str = "observed", least: int = 2) -> DataFrame:
    """Cosine, norms and their ratio of each group's predicted and observed vectors; null below ``least`` components."""
    x = df.filter(F.col(predicted).isNotNull() & F.col(observed).isNotNull())
    pp, oo, po = (F.sum(F.col(a) * F.col(b)) for a, b in ((predicted, predicted), (observed, observed), (predicted, observed)))
    enough = F.count("*") >= least
    return x.groupBy(by).agg(
        F.count("*").alias("n"), F.when(enough, ratio(po, F.sqrt(pp * oo))).alias("cosine"), F.when(enough, F.sqrt(pp)).alias("norm_predicted"),
        F.when(enough, F.sqrt(oo)).alias("norm_observed"), F.when(enough, ratio(F.sqrt(pp), F.sqrt(oo))).alias("norm_ratio"),
    )


def origin_slope(df: DataFrame, *by: str, predicted: str = "predicted", observed: str = "observed") -> DataFrame:
    """Slope through the origin, sum(xy) / sum(yy)."""
    return df.groupBy(*by).agg(ratio(F.sum(F.col(predicted) * F.col(observed)), F.sum(F.col(observed) * F.col(observed))).alias("slope"))
