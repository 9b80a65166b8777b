"""Shared helpers: the cluster's shared folder, written intermediate tables, binary files, row keys."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white-space class and word classes of the query contracts, as Java regular expressions.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
NON_WORD_CLASS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Bitmaps of 4 KB that are broadcast at most: 64 MB, for up to half a thousand million rows.
BITMAPS = 16_384


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which every executor can reach.

    Only where that setting is absent on a single machine, as in tests, a temporary folder takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = os.path.join(tempfile.gettempdir(), "spindrift-checkpoints")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table from ``write_table`` that nothing reads any more."""
    spark = df.sparkSession
    folders = {f.rpartition("/")[0] for f in df.inputFiles()}
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def pick_rows(df: DataFrame, row: str, chosen: DataFrame) -> DataFrame:
    """The rows of ``df`` whose number ``row`` is in ``chosen``, a written table, without shuffling ``df``.

    The chosen numbers are packed into bitmaps, each of 32,768 numbers in 4 KB. Up to ``BITMAPS`` of them are
    broadcast (one bit a row of ``df``, where it was numbered); beyond, rows meet in a shuffled join.
    """
    bits = chosen.groupBy(F.bitmap_bucket_number(row).alias("__sd_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(row)).alias("__sd_bits"))
    bits = write_table(bits, "bitmaps")
    if bits.count() > BITMAPS:
        return df.join(chosen.select(row).distinct(), row, "left_semi")
    at = F.bitmap_bit_position(row)
    byte = F.conv(F.hex(F.expr(f"substring(__sd_bits, CAST(bitmap_bit_position({row}) DIV 8 + 1 AS INT), 1)")), 16, 10).cast("int")
    joined = df.withColumn("__sd_bucket", F.bitmap_bucket_number(row)).join(F.broadcast(bits), "__sd_bucket")
    return joined.filter(F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(F.lit(1)) == 1).select(df.columns)


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20) -> None:
    """Bound the rows and the bytes of an Arrow batch, unless the user has lowered the bounds already.

    A single row of more bytes is a batch by itself; no text is cut.
    """
    for key, bound in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.conf.get(key).lower()
        if not now.rstrip("b").isdigit() or not 0 < int(now.rstrip("b")) <= bound:
            spark.conf.set(key, bound)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def lower_ascii(col: Column) -> Column:
    """Lower-case A-Z only; other letters stay."""
    return F.translate(col, UPPER, LOWER)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, even where ``use`` refers to it inside lambdas
    (an outer column that the optimiser inlines into a lambda would be computed for each element)."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words(col: Column, separators: str) -> Column:
    """The words between runs of ``separators`` (a Java class with +); null gives an empty array."""
    return F.filter(F.split(F.coalesce(col, F.lit("")), separators), lambda w: w != F.lit(""))


def chunks(texts: list[str], most: int) -> Iterator[tuple[int, list[str]]]:
    """Split a batch into runs of about ``most`` characters; every text stays whole."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield at, texts[at:i]
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, texts[at:]


def open_fs(uri: str):
    """(filesystem, path) of pyarrow for a folder or file; plain paths count as local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)
