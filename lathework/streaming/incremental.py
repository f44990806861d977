"""Incremental counts over an event stream: the streaming form of the long count matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str = "ts", sample: str = "user_id", feature: str = "event_type", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums per window, sample and feature; rows later than ``late`` are left out once their window has closed.

    Works on batch and streaming frames alike.
    """
    own = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if events.isStreaming else events
    return own.groupBy(F.window(time, window).alias("w"), F.col(sample).alias("sample_id"), F.col(feature).alias("feature_id")).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "sample_id", "feature_id", "n", "total")


def run_available(events: DataFrame, path: str, checkpoint: str, **how) -> None:
    """Process what is there and stop; a later call goes on from the checkpoint."""
    query = windowed_counts(events, **how).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def daily_counts(rows: DataFrame, time: str = "ts", sample: str = "user_id", feature: str = "event_type", value: str = "value") -> DataFrame:
    """``(sample_id, feature_id, n, total, day)`` of a batch of rows; without a time the day is null."""
    own = rows.select(F.col(sample).alias("sample_id"), F.col(feature).alias("feature_id"), F.to_date(F.col(time)).alias("day"), F.col(value).alias("value"))
    return own.groupBy("day", "sample_id", "feature_id").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("double")).alias("total")).select("sample_id", "feature_id", "n", "total", "day")


def merged_counts(parts: DataFrame) -> DataFrame:
    """The same over the parts of several batches."""
    return parts.groupBy("day", "sample_id", "feature_id").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).select("sample_id", "feature_id", "n", "total", "day")
