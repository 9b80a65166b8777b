"""The cluster's shared folder and tables written there to cut lineage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which every executor can reach.

    Only where that setting is absent on a single machine, as in tests, a temporary folder takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(os.path.join(tempfile.gettempdir(), "spindrift-checkpoints"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Folders of the tables that this process has written and not dropped yet.
_written: set[str] = set()


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back."""
    path = shared_dir(df.sparkSession, name)
    _written.add(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append_table(df: DataFrame, path: str) -> None:
    """Add the rows of ``df``, as Parquet, to those of a folder from ``shared_dir``."""
    _written.add(path)
    df.write.mode("append").parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table from ``write_table`` that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        _delete(spark, folder)


def clear_written(spark: SparkSession) -> int:
    """Delete all tables that ``write_table`` has left behind in this process, once no result that reads them is needed
    any more (a query's result reads them until it is written); gives their number."""
    left = list(_written)
    for folder in left:
        _delete(spark, folder)
    _written.clear()
    return len(left)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _written.discard(folder)
    _written.discard(folder.removeprefix("file:").replace("//", "/") if folder.startswith("file:") else folder)
