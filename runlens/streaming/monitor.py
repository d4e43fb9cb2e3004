"""Streams of runs: an extension, as the queries themselves are batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def manifest_stream(spark: SparkSession, path: str) -> DataFrame:
    """New manifest files as (path, text) rows."""
    return spark.readStream.format("text").option("wholetext", True).load(path).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def windowed(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and means of value by event_type in tumbling windows; rows later than the watermark go."""
    g = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n", "mean")
