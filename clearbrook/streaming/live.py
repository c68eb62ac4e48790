"""Live forms of row-local operators with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clearbrook.operators.logs import normalise_entries

LINE = r"^\s*(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2})\s+\[(\w+)\]\s+([^:]+):\s*(.*?)\s*$"


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.text(path)


def normalise_log_stream(lines: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Typed events of single-line entries as they arrive, each (source, timestamp, message) once while the watermark allows."""
    e = lines.where(F.col("value").rlike(LINE))
    e = e.select(*[F.regexp_extract("value", LINE, i).alias(n) for i, n in enumerate(["timestamp", "level", "source", "message"], 1)])
    e = e.withColumn("event_time", F.try_to_timestamp("timestamp", F.lit("yyyy-MM-dd HH:mm:ss"))).withWatermark("event_time", delay)
    return normalise_entries(e.dropDuplicatesWithinWatermark(["source", "timestamp", "message"]))


def event_counts(events: DataFrame, window: str = "1 hour") -> DataFrame:
    """Events of each type in each window, and how many need review."""
    return events.groupBy(F.window("event_time", window), "event_type").agg(F.count("*").alias("n"), F.count_if("review_needed").alias("review"))
