"""Coordinate matrices read as a stream of blocks and folded into several outputs at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir


def write_blocks(x: DataFrame, folder: str, blocks: int) -> None:
    """(row, col, value), 0-based, as gzip text blocks of 1-based coordinates; every block is one file of the stream."""
    line = F.concat_ws(" ", (F.col("row") + 1).cast("string"), (F.col("col") + 1).cast("string"), F.col("value").cast("string"))
    x.select(line.alias("value")).repartition(blocks).write.option("compression", "gzip").text(folder)


def routed(spark: SparkSession, folder: str, routes: DataFrame, files: int = 4) -> tuple[DataFrame, DataFrame]:
    """((output, target, col, value), (entries)): every entry of the blocks in ``folder``, once read, summed in each output that
    ``routes`` (output, row, target) sends its row to; rows without a route are dropped. Files are taken a few at a time.

    A micro-batch leaves its partial sums in a folder named for it, which a replay after a lost driver overwrites, so nothing is
    added twice; the sums over all batches are the result. ``entries`` counts the lines read, to be held against the header."""
    out = shared_dir(spark, "routed")
    lines = spark.readStream.option("maxFilesPerTrigger", files).schema("value string").text(folder)
    parts = F.split(F.trim("value"), r"\s+")
    cells = lines.filter(~F.col("value").startswith("%")).select((parts[0].cast("long") - 1).alias("row"), (parts[1].cast("long") - 1).alias("col"), F.coalesce(F.try_element_at(parts, F.lit(3)).cast("double"), F.lit(1.0)).alias("value"))

    def fold(batch: DataFrame, number: int) -> None:
        sums = batch.join(routes, "row").groupBy("output", "target", "col").agg(F.sum("value").alias("value"))
        sums.write.mode("overwrite").parquet(f"{out}/sums/batch={number}")
        batch.agg(F.count("*").alias("entries")).write.mode("overwrite").parquet(f"{out}/entries/batch={number}")

    cells.writeStream.foreachBatch(fold).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    types = {f.name: f.dataType.simpleString() for f in routes.schema}
    sums = spark.read.schema(f"output {types['output']}, target {types['target']}, col long, value double, batch int").parquet(f"{out}/sums")
    entries = spark.read.schema("entries long, batch int").parquet(f"{out}/entries").agg(F.sum("entries").alias("entries"))
    return sums.groupBy("output", "target", "col").agg(F.sum("value").alias("value")), entries
