"""Streaming queries run to completion over the event files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.operators.selection import SelectionParams
from rillflow.operators.sessions import seconds
from rillflow.plans.lineage import shared_dir
from rillflow.session import table
from rillflow.streaming.registry import registered, stream_registry, with_rocksdb
from rillflow.streaming.sessions import event_stream, run_to_table, stream_distinct, stream_sessions, stream_windows
from rillflow.streaming.state import stream_buffer, stream_selection, tail_to

PARTS, FILES = 5, 2
#: Longer than the events table: within it a key stays known, and a machine stays open.
WHOLE_SEC = 40 * 86400.0


def _run(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """All rows that a stream emits, through a table in the shared folder."""
    place = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    run_to_table(stream, f"{place}/rows", f"{place}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{place}/rows")


def in_parts(spark: SparkSession, sf_dir: str, parts: int = PARTS) -> str:
    """A folder to which the events were written in ``parts`` equal stretches of time, one after the other, as ``FILES`` files each."""
    events = table(spark, sf_dir, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    low, high = events.agg(F.min(at), F.max(at)).first()
    folder = f"{shared_dir(spark)}/stream-events-{uuid.uuid4().hex}"
    for k in range(parts if low is not None else 0):
        here = F.expr(f"(unix_micros(cast(ts AS timestamp)) - {low}L) * {parts} div {high - low + 1}L") == k
        events.filter(here).repartition(FILES).write.mode("append").parquet(folder)
    return folder


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as they arrive: a stretch of time in every micro-batch, so that state is carried from batch to batch."""
    return event_stream(spark, in_parts(spark, sf_dir), files_per_trigger=FILES)


def in_micros(rows: DataFrame) -> DataFrame:
    """Times as microseconds since the epoch, values to four places."""
    kinds = dict(rows.dtypes)
    return rows.select(*[F.unix_micros(c).alias(c) if kinds[c] == "timestamp" else F.round(c, 4).alias(c) if kinds[c] == "double" else F.col(c) for c in rows.columns])


def stream_event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that the watermark has closed by the end of the stream."""
    return in_micros(_run(spark, stream_sessions(_events(spark, sf_dir), ["event_type"], "1800 seconds")))


def stream_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that the watermark has closed by the end of the stream."""
    return in_micros(_run(spark, stream_windows(_events(spark, sf_dir), "1 hour", "30 minutes")))


def stream_first_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users and the types they were seen with, each once."""
    return _run(spark, stream_distinct(_events(spark, sf_dir), ["user_id", "event_type"], f"{int(WHOLE_SEC)} seconds").select("user_id", "event_type"))


def stream_detection_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buffer sizes at every micro-batch; times stay as they are, as rounding them would depend on how a tie is rounded."""
    return _run(spark, stream_buffer(_events(spark, sf_dir).withColumn("at_sec", seconds(F.col("ts"))), "user_id", 86400.0))


def stream_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row once, through a sink that is handed the micro-batches; a batch that comes again replaces its rows."""
    place = f"{shared_dir(spark)}/tail-{uuid.uuid4().hex}"
    tail_to(_events(spark, sf_dir), lambda rows, n: rows.write.mode("overwrite").parquet(f"{place}/batch={n}"), uuid.uuid4().hex)
    return spark.read.parquet(place).select("event_id", "event_type", "batch")


def stream_frame_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select("ts", F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("frame_id"), seconds(F.col("ts")).alias("at_sec"), (F.col("value") / 50000).alias("ratio"), (F.col("event_id") % 10 / 10.0).alias("area"), (F.col("value") / 10000).alias("signature"))
    params = SelectionParams(max_gap_sec=86400.0, early_interval_sec=7200.0, strong_interval_sec=3600.0, early_cooldown_sec=14400.0, strong_cooldown_sec=14400.0, fast_interval_sec=3600.0, slow_interval_sec=21600.0)
    return _run(spark, stream_selection(e, params, idle_sec=WHOLE_SEC))


def stream_job_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What bounded registries of the users' events hold when the stream has ended."""
    with with_rocksdb(spark):
        changes = _run(spark, stream_registry(_events(spark, sf_dir).withColumn("at_sec", seconds(F.col("ts"))), "user_id", "event_id", "at_sec", idle_sec=WHOLE_SEC))
    return registered(changes).select(F.col("id").alias("event_id"), F.col("key").cast("long").alias("user_id"))


QUERIES = {f.__name__: f for f in (stream_job_registry, stream_event_sessions, stream_event_windows, stream_first_by_user, stream_detection_buffer, stream_tail, stream_frame_selection)}
_WATERMARK = "(SELECT (epoch_us(max(ts)) // 1000) * 1000 - 90000000 FROM events)"
_PARTS = "(epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) * 5 // ((SELECT max(epoch_us(ts)) - min(epoch_us(ts)) FROM events) + 1)"
ORACLE_SQL = {
    "stream_job_registry": "SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events) WHERE back <= 50",
    "stream_first_by_user": "SELECT DISTINCT user_id, event_type FROM events",
    "stream_tail": f"SELECT event_id, event_type, CAST({_PARTS} AS INTEGER) AS batch FROM events",
    "stream_detection_buffer": f"""
WITH p AS (SELECT user_id, epoch(ts) AS s, {_PARTS} AS part FROM events), m AS (SELECT user_id, part, max(s) AS newest FROM p GROUP BY user_id, part)
SELECT CAST(m.user_id AS VARCHAR) AS source, count(*) AS n_buffered, newest AS newest_sec FROM m JOIN p ON p.user_id = m.user_id AND p.part <= m.part AND p.s >= newest - 86400 GROUP BY m.user_id, m.part, newest""",
    "stream_event_sessions": f"""
WITH e AS (SELECT event_type, epoch_us(ts) AS us, value FROM events),
o AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY event_type ORDER BY us) > 1800000000 THEN 1 ELSE 0 END AS opened FROM e),
n AS (SELECT *, sum(opened) OVER (PARTITION BY event_type ORDER BY us ROWS UNBOUNDED PRECEDING) AS session_no FROM o)
SELECT event_type, min(us) AS start_at, max(us) AS end_at, count(*) AS occurrence_count, round(max(value), 4) AS top_value FROM n GROUP BY event_type, session_no HAVING max(us) + 1800000000 <= {_WATERMARK}""",
    "stream_event_windows": f"""
WITH e AS (SELECT event_type, epoch_us(ts) AS us, value FROM events),
w AS (SELECT event_type, value, unnest([us - us % 1800000000, us - us % 1800000000 - 1800000000]) AS start_at FROM e)
SELECT start_at, start_at + 3600000000 AS end_at, event_type, count(*) AS n, round(CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) / count(value), 4) AS mean_value FROM w GROUP BY start_at, event_type HAVING start_at + 3600000000 <= {_WATERMARK}""",
}
