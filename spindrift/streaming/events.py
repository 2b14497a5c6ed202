"""Windowed counts over event streams.  Additional to the document tools: Spark's own streaming engine, as a plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """Events read as a stream of Parquet files with the batch table's schema."""
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed(events: DataFrame, size: str = "1 day", late: str = "1 day") -> DataFrame:
    """start, event_type, n, total in tumbling windows; works on streams (with a watermark) and tables."""
    source = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = source.groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """user_id, start, end, n: sessions that end after a gap."""
    source = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = source.groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return grouped.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")
