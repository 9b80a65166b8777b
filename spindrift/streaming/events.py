"""Event streams: windowed statistics with watermarks, sessions, incremental sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.shared import shared_dir


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """Parquet files of events as they arrive; ``ts`` becomes an event-time timestamp."""
    schema = spark.read.parquet(path).schema
    # a glob stands for a folder as well as for a single file, which streams don't take as their base path
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{path[:-1]}[{path[-1]}]")
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, key: str, value: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Count, mean and extremes per key and window; state older than the watermark is dropped."""
    w = F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w, key).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most")).select(F.col("window.start").alias("start"), key, "n", "mean", "least", "most")


def sessions(events: DataFrame, key: str, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Sessions per key, closed by a gap."""
    s = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy(s, key).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def incremental_sums(cells: DataFrame, *keys: str, value: str = "value") -> DataFrame:
    """Running sums of an unbounded coordinate stream, for complete mode."""
    return cells.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that has arrived and return what it wrote: the batch form for queries and tests.

    Append mode holds back windows that the watermark has not passed; complete mode returns all.
    """
    spark = stream.sparkSession
    out, state = shared_dir(spark, "stream-out"), shared_dir(spark, "stream-state")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={number}")

    query: StreamingQuery = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
