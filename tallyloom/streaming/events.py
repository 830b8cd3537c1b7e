"""Streaming over the events table: windowed counts with late data bounded by a watermark. An extension beside the batch plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def stream(spark: SparkSession, folder: str, files: int = 1) -> DataFrame:
    """The parquet files of a folder as a stream, `files` at a time."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(folder)


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Events per hour and type, final once the watermark has passed the hour; a stream and a table give the same rows."""
    x = events.withWatermark("ts", late) if events.isStreaming else events
    agg = x.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return agg.select(F.col("w.start").alias("hour"), "event_type", "n", "total")


def run_once(result: DataFrame, checkpoint: str, sink: str) -> None:
    """Everything that is there now, exactly once: append mode, a checkpoint and a parquet sink."""
    q = result.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(sink)
    q.awaitTermination()
