"""Gap sessionization of events and the fold of each session into one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillflow.session import table

MERGE_GAP_SEC = 10.0
CARRIER_GAP_SEC = 1800.0


def seconds(ts: Column) -> Column:
    """Seconds since the epoch, as double; zone-less timestamps count as UTC."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def number_sessions(events: DataFrame, keys: list[str], at: str, gap_sec: float = MERGE_GAP_SEC, tie: str | None = None, bucket_sec: float | None = None) -> DataFrame:
    """Add ``session_no`` (from 0, by start): a new session begins when the time since the key's previous row exceeds ``gap_sec``.

    A gap of exactly ``gap_sec`` still merges.  Rows with a null time come first
    and belong to their key's first session.  ``tie`` orders rows of equal time.

    A key's rows are dealt out by time bucket, so that a key with very many rows
    is spread over tasks: gaps are found inside a bucket, and a short table of
    bucket ends per key tells what lies before each bucket and how many sessions
    began there.
    """
    width = bucket_sec or 16 * max(gap_sec, 1.0)
    bucketed = events.withColumn("__bucket", F.coalesce(F.floor(F.col(at) / width), F.lit(-(1 << 62))))
    order = [F.col(at).asc_nulls_first()] + ([F.col(tie)] if tie else [])
    inside = Window.partitionBy(*keys, "__bucket").orderBy(*order)
    along = Window.partitionBy(*[f"__{k}" for k in keys]).orderBy("__b")
    breaks = lambda now, before: F.coalesce((now - before > gap_sec).cast("int"), F.lit(0))
    marked = bucketed.withColumn("__new", breaks(F.col(at), F.lag(at).over(inside)))
    ends = (
        marked.groupBy(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__bucket").alias("__b")).agg(F.min(at).alias("__low"), F.max(at).alias("__high"), F.sum("__new").alias("__inner"))
        .withColumn("__open", breaks(F.col("__low"), F.lag("__high").over(along)))
        .withColumn("__ahead", F.coalesce(F.sum(F.col("__inner") + F.col("__open")).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("__open"))
        .select(*[f"__{k}" for k in keys], "__b", "__ahead")
    )
    same = F.col("__bucket") == F.col("__b")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    joined = marked.join(ends, same)
    return joined.withColumn("session_no", F.col("__ahead") + F.sum("__new").over(inside)).drop("__bucket", "__b", "__new", "__ahead", *[f"__{k}" for k in keys])


def sessionize(events: DataFrame, keys: list[str], at: str, confidence: str, gap_sec: float = MERGE_GAP_SEC, tie: str | None = None) -> DataFrame:
    """One row per session: start, end, count and the highest confidence plus 0.05 for each further row, at most 1."""
    numbered = number_sessions(events, keys, at, gap_sec, tie)
    return numbered.groupBy(*keys, "session_no").agg(
        F.min(at).alias("start_sec"),
        F.max(at).alias("end_sec"),
        F.count("*").alias("occurrence_count"),
        F.least(F.lit(1.0), F.max(confidence) + 0.05 * (F.count("*") - 1)).alias("confidence"),
    )


def carrier_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as detections: name, time in seconds and a confidence from the value."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        F.col("event_type").alias("event_name"),
        seconds(F.col("ts")).alias("at"),
        F.least(F.lit(1.0), F.col("value") / 100).alias("confidence"),
        "value",
    )


def carrier_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessionize(carrier_events(spark, sf_dir), ["event_name"], "at", "confidence", CARRIER_GAP_SEC, "event_id")


def q_sessionize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return carrier_sessions(spark, sf_dir).select(
        "event_name",
        "session_no",
        F.round("start_sec", 3).alias("start_sec"),
        F.round("end_sec", 3).alias("end_sec"),
        "occurrence_count",
        F.round("confidence", 4).alias("confidence"),
    )


SESSIONS_CTE = """
marked AS (
  SELECT event_id, event_type AS event_name, epoch(ts) AS at_sec, least(1.0, value / 100) AS confidence,
         CASE WHEN epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY event_type ORDER BY ts, event_id) > 1800 THEN 1 ELSE 0 END AS opened
  FROM events),
numbered AS (
  SELECT *, sum(opened) OVER (PARTITION BY event_name ORDER BY at_sec, event_id ROWS UNBOUNDED PRECEDING) AS session_no FROM marked),
sessions AS (
  SELECT event_name, CAST(session_no AS BIGINT) AS session_no, min(at_sec) AS start_sec, max(at_sec) AS end_sec, count(*) AS occurrence_count,
         least(1.0, max(confidence) + 0.05 * (count(*) - 1)) AS confidence
  FROM numbered GROUP BY event_name, session_no)
"""

QUERIES = {"q_sessionize": q_sessionize}
ORACLE_SQL = {
    "q_sessionize": f"WITH {SESSIONS_CTE} SELECT event_name, session_no, round(start_sec, 3) AS start_sec, round(end_sec, 3) AS end_sec, occurrence_count, round(confidence, 4) AS confidence FROM sessions"
}
