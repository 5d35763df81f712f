"""Streaming forms: tumbling and session activity, running address activity, first-wins deduplication.

Windows are epoch-aligned like the batch ones. Late rows beyond the watermark are dropped by
Structured Streaming; everything else equals the batch result once the stream has ended.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the event files under a folder."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, length: str = "1 day", late: str = "2 days") -> DataFrame:
    w = F.window("ts", length)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.unix_micros("w.start").alias("start_us"), "user_id", "n", F.round("total", 6).alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 days") -> DataFrame:
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.unix_micros("w.start").alias("start_us"), "user_id", "n")


def first_wins(events: DataFrame, key: str, late: str = "30 days") -> DataFrame:
    """The first row of each key that arrives."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def drain(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run a stream over what there is and return what it wrote, exactly once, under path."""
    q = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/rows")
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")
