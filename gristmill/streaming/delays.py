"""Delay events as a stream: daily counts by supplier with a watermark, and their seven-day sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LATE = "2 days"
WINDOW, SLIDE = "7 days", "1 day"


def read_events(spark: SparkSession, folder: str, schema) -> DataFrame:
    """A folder of Parquet files as a stream; event times are zone-less in the files."""
    return spark.readStream.schema(schema).parquet(folder)


def recent_delays(events: DataFrame, late: str = LATE, window: str = WINDOW, slide: str = SLIDE) -> DataFrame:
    """supplier_id, window_end, recent_delay_events over sliding windows of event time; rows later than `late` are dropped.

    State is one counter for each supplier and open window, whatever the number of events.
    """
    delays = events.where("event_type = 'delay'").withColumn("at", F.col("event_date").cast("timestamp_ltz")).withWatermark("at", late)
    return delays.groupBy("supplier_id", F.window("at", window, slide)).agg(F.count("*").alias("recent_delay_events")).select("supplier_id", F.col("window.end").alias("window_end"), "recent_delay_events")


def run_to(df: DataFrame, name: str, checkpoint: str, mode: str = "append"):
    """Process what is there into an in-memory table of that name, and stop."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
