"""Streaming sessions, windows and duplicate suppression over an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.session import table

LATENESS = "90 seconds"
EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, names: str = "*.parquet", schema: str = EVENT_SCHEMA, files_per_trigger: int = 1) -> DataFrame:
    """A stream of the Parquet event files that arrive in a folder under matching names, with the time as a zoned timestamp."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", names).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def stream_sessions(events: DataFrame, keys: list[str], gap: str, lateness: str = LATENESS) -> DataFrame:
    """Gap sessions per key; rows later than the watermark are dropped, a gap of exactly ``gap`` merges."""
    watched = events.withWatermark("ts", lateness)
    grouped = watched.groupBy(F.session_window("ts", gap).alias("w"), *keys).agg(F.count("*").alias("occurrence_count"), F.max("value").alias("top_value"), F.max("ts").alias("end_at"))
    return grouped.select(*keys, F.col("w.start").alias("start_at"), "end_at", "occurrence_count", "top_value")


def stream_windows(events: DataFrame, width: str, slide: str | None = None, lateness: str = LATENESS) -> DataFrame:
    """Tumbling or overlapping windows with counts and mean value by event type; values are summed to four places, so the order of arrival does not matter."""
    watched = events.withWatermark("ts", lateness)
    span = F.window("ts", width, slide) if slide else F.window("ts", width)
    return watched.groupBy(span.alias("w"), "event_type").agg(F.count("*").alias("n"), (F.sum(F.col("value").cast("decimal(18,4)")).cast("double") / F.count("value")).alias("mean_value")).select(F.col("w.start").alias("start_at"), F.col("w.end").alias("end_at"), "event_type", "n", "mean_value")


def stream_distinct(events: DataFrame, keys: list[str], lateness: str = LATENESS) -> DataFrame:
    """The first row of every key within the watermark's reach."""
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(keys)


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process everything that is there and write it exactly once to a Parquet table."""
    stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def batch_sessions(spark: SparkSession, sf_dir: str, gap: str = "1800 seconds") -> DataFrame:
    """The same sessions in batch, for comparison."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return stream_sessions(events, ["event_type"], gap)
