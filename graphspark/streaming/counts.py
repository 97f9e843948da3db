"""Edge and event counts kept up to date by streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def running_counts(events: DataFrame) -> DataFrame:
    """Counts by type as rows come in; write with output mode ``update`` or ``complete``."""
    return events.groupBy("event_type").agg(F.count("*").alias("n"))


def windowed(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts and sums of time windows; rows later than ``late`` go."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(
        F.count("*").alias("n"), F.sum("value").alias("total")
    ).select(F.col("w.start").alias("start"), "event_type", "n", "total")
