"""A daily panel from a stream of events, for observations that arrive one by one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def daily_panel(events: DataFrame, late: str = "2 days") -> DataFrame:
    """(Date, Ticker, Price, Volume): per day and event type, the mean value and their number.

    ``events`` may be a stream or a table. In a stream, a day is final when the watermark has passed it.
    """
    seen = events.select("ts", "event_type", "value")
    if events.isStreaming:
        seen = seen.withWatermark("ts", late)
    per = seen.groupBy(F.window("ts", "1 day").alias("w"), F.col("event_type").alias("Ticker")).agg(F.avg("value").alias("Price"), F.count("*").alias("Volume"))
    return per.select(F.col("w.start").cast("date").alias("Date"), "Ticker", "Price", "Volume")


def stream(spark: SparkSession, folder: str) -> DataFrame:
    """Event files of a folder as a stream."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))
