"""Structured Streaming forms of the incremental operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A folder of Parquet files as a stream, the clock column as a timestamp."""
    return spark.readStream.schema(schema).parquet(path)


def window_counts(events: DataFrame, time: str, kind: str, size: str, late: str) -> DataFrame:
    """Events and value sums per window and kind; events later than ``late`` are left out."""
    e = events.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", late)
    return e.groupBy(F.window("_at", size).alias("w"), kind).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), kind, "n", "total")


def sessions(events: DataFrame, time: str, key: str, gap: str, late: str) -> DataFrame:
    """Runs of a key's events with pauses under ``gap``."""
    e = events.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", late)
    return e.groupBy(F.session_window("_at", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def followed_log(spark: SparkSession, folder: str) -> DataFrame:
    """Lines appended to log files of a folder."""
    return spark.readStream.text(folder)


def drain(stream: DataFrame, name: str, mode: str, checkpoint: str) -> None:
    """Run a stream over all that is there into an in-memory table."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def drain_to(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Run an append stream over all that is new into Parquet files; a second call goes on where the first ended."""
    stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
