"""Loading of tables, and checks that fail early."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table; timestamps without zone are read as UTC timestamps."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    naive = [c for c, t in df.dtypes if t == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in naive}) if naive else df


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
    return df


def require_unique(df: DataFrame, *keys: str) -> DataFrame:
    """Raise if a key occurs twice (an action: one aggregation)."""
    twice = df.groupBy(*keys).count().filter("count > 1").limit(3).collect()
    if twice:
        raise ValueError(f"keys {keys} are not unique: {twice}")
    return df


def coordinate_matrix(spark: SparkSession, path: str) -> DataFrame:
    """MatrixMarket coordinate text as (row, col, value), 0-based, read in splits by all executors."""
    lines = spark.read.text(path).filter(~F.col("value").startswith("%"))
    parts = F.split(F.trim("value"), r"\s+")
    cells = lines.select(parts[0].cast("long").alias("r"), parts[1].cast("long").alias("c"), F.try_element_at(parts, F.lit(3)).cast("double").alias("v"), F.size(parts).alias("n"), F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i"))
    # the size line is the first that is no comment; it has the smallest id of its file
    first = cells.groupBy("f").agg(F.min("i").alias("i"))
    return cells.join(F.broadcast(first), ["f", "i"], "left_anti").select((F.col("r") - 1).alias("row"), (F.col("c") - 1).alias("col"), F.coalesce("v", F.lit(1.0)).alias("value"))


def wide_table(spark: SparkSession, path: str, id_column: str, sep: str = "\t") -> DataFrame:
    """A feature-by-unit text table as long (unit, feature, value)."""
    df = spark.read.csv(path, sep=sep, header=True)
    units = [c for c in df.columns if c != id_column]
    return df.unpivot([id_column], units, "unit", "value").select("unit", F.col(id_column).alias("feature"), F.expr("try_cast(value as double)").alias("value"))
