"""Counts and indicators over stored analyses, their integrity and degradation states, and the client's order of events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillflow.operators.ranges import ranked
from rillflow.operators.sessions import seconds
from rillflow.operators.traces import explode_trace, one_per_stage, status_counts
from rillflow.session import table

FORBIDDEN_KEYS = ("base64_image", "image_bytes", "raw_response")
FAILED_PREFIX = "[HATA]"
TAIL_SEC = 5.0
REGISTRY_SIZE = 50
RISK_RANKS = (("crit", 3), ("high", 2), ("mid", 1), ("low", 0))


def system_overview(jobs: DataFrame, status: str, trace: str, conversations: DataFrame, messages: DataFrame, latest: int | None = None, order: list[Column] | None = None) -> DataFrame:
    """One row: analyses by status and with a trace, conversations and messages.

    ``latest`` looks at that many jobs by ``order`` only, as a dashboard does; without it all are counted.
    """
    seen = jobs if latest is None else jobs.orderBy(*(order or [])).limit(latest)
    parts = [
        status_counts(seen, status), seen.agg(F.count_if(F.coalesce(F.col(trace), F.lit("")) != "").alias("with_trace")),
        conversations.agg(F.count("*").alias("n_conversations")), messages.agg(F.count("*").alias("n_messages")),
    ]
    together = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return together.agg(*[F.max(c).alias(c) for c in together.columns])


def referenced_frames(jobs: DataFrame, trace: str, job: str) -> DataFrame:
    """(job, frame_id) for every frame that the first sampler event of a trace names."""
    first = one_per_stage(explode_trace(jobs, trace).filter("stage = 'sampler'"), job)
    frames = first.select(job, F.explode(F.expr("try_variant_get(data, '$.evidence_frames', 'array<variant>')")).alias("frame"))
    named = frames.select(job, F.expr("try_variant_get(frame, '$.frame_id', 'string')").alias("frame_id"))
    return named.filter(F.coalesce("frame_id", F.lit("")) != "")


def stored_frame_counts(jobs: DataFrame, trace: str, job: str, stored: DataFrame) -> DataFrame:
    """(job, n_frames): how many of the frames that a job's trace names are stored; 0 where the trace is missing or broken."""
    counts = referenced_frames(jobs, trace, job).join(stored.select(job, "frame_id").distinct(), [job, "frame_id"], "left_semi").groupBy(job).agg(F.count("*").alias("n_frames"))
    return jobs.select(job).join(counts, job, "left").select(job, F.coalesce("n_frames", F.lit(0)).alias("n_frames"))


def processing_seconds(elapsed_sec: Column, total_ms: Column) -> Column:
    """The sampler's own measurement if it is positive, else the sum of the steps; null where nothing was measured."""
    return F.when(elapsed_sec > 0, elapsed_sec).when(total_ms > 0, total_ms / 1000)


def effective_duration(last_sec: Column) -> Column:
    """The length that a timeline shows: a little more than the last event's time."""
    return last_sec + TAIL_SEC


def integrity(rows: DataFrame, group: str, analysis: str) -> DataFrame:
    """Per group: number of analyses, and for a group that mixes several the state partial with its reason; others have none."""
    per = rows.groupBy(group).agg(F.countDistinct(analysis).alias("n_analyses"))
    mixed = F.col("n_analyses") > 1
    return per.select(group, "n_analyses", F.when(mixed, "partial").alias("analysis_status"), F.when(mixed, "provenance_integrity_failed").alias("parse_status"))


def degraded_status(status: Column, description: Column) -> Column:
    """failed, partial_failure or completed: a missing status is read from the description's mark."""
    failed = (status == "failed") | (status.isNull() & F.startswith(description, F.lit(FAILED_PREFIX)))
    return F.when(failed, "failed").when(status == "partial_failure", "partial_failure").otherwise(F.coalesce(status, F.lit("completed")))


def leaked_keys(payload: Column, forbidden: tuple[str, ...] = FORBIDDEN_KEYS) -> Column:
    """Keys of a JSON object that must never leave the service, sorted; empty for clean, missing and broken payloads."""
    keys = F.coalesce(F.json_object_keys(payload), F.array().cast("array<string>"))
    return F.array_sort(F.array_intersect(keys, F.array(*map(F.lit, forbidden))))


def client_order(rows: DataFrame, key: str, level: str, by: str, at: str, tie: str, place: str = "place") -> DataFrame:
    """Add ``place`` within ``key``: by time, by falling risk rank or by falling confidence; equal rows keep their order of arrival."""
    rank = F.lit(None).cast("int")
    for name, value in RISK_RANKS:
        rank = F.when(F.col(level) == name, value).otherwise(rank)
    first = {"time": F.col(at).asc(), "risk": rank.desc(), "confidence": F.col("confidence").desc()}[by]
    return ranked(rows, [key], [first, F.col(tie).asc()], place)


def registry(rows: DataFrame, key: str, order: list[Column], most: int = REGISTRY_SIZE) -> DataFrame:
    """What a bounded registry holds after all insertions: each key's last ``most`` rows, the oldest having gone first."""
    return rows.withColumn("back", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("back") <= most)


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trace for every event: one sampler event that names three frames, and for odd ids a second one that does not count."""
    e = table(spark, sf_dir, "events")
    frame = lambda d: F.struct(F.concat(F.lit("f"), (F.col("event_id") + d).cast("string")).alias("frame_id"))
    sampler = lambda *ds: F.struct(F.lit("sampler").alias("stage"), F.struct(F.array(*map(frame, ds)).alias("evidence_frames")).alias("data"))
    trace = F.when(F.col("event_id") % 11 == 0, "broken").when(F.col("event_id") % 2 == 0, F.to_json(F.array(sampler(0, 1, 7)))).otherwise(F.to_json(F.array(sampler(0, 1, 7), sampler(0))))
    return e.select("event_id", "value", trace.alias("trace_json"))


def q_system_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "failed").otherwise("queued").alias("status"), F.when(F.col("o_orderkey") % 3 != 0, "[]").alias("trace_json"))
    messages = table(spark, sf_dir, "conversations")
    return system_overview(o, "status", "trace_json", messages.select("conv_id").distinct(), messages)


def q_stored_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "events").filter("value < 250").select("event_id", F.explode(F.array(*[F.concat(F.lit("f"), (F.col("event_id") + d).cast("string")) for d in (0, 7)])).alias("frame_id"))
    return stored_frame_counts(_jobs(spark, sf_dir), "trace_json", "event_id", stored)


def q_referenced_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames that some trace names: only those are kept."""
    refs = referenced_frames(_jobs(spark, sf_dir), "trace_json", "event_id")
    frames = table(spark, sf_dir, "events").select(F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("frame_id"), "event_id")
    return frames.join(refs.select("frame_id").distinct(), "frame_id", "left_semi").select("event_id", "frame_id")


def q_processing(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    at = seconds(F.col("ts"))
    per = e.groupBy("user_id").agg(
        F.max(F.when(F.col("user_id") % 2 == 0, F.col("value"))).alias("elapsed"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("total_ms"),
        (F.max(at) - F.min(at)).alias("last_sec"), F.count("*").alias("n_frames"), F.countDistinct(F.when(F.col("value") >= 100, F.col("event_type"))).alias("n_stages"),
    )
    sec = processing_seconds(F.col("elapsed"), F.col("total_ms"))
    return per.select("user_id", F.round(sec, 3).alias("processing_sec"), F.round(sec / effective_duration(F.col("last_sec")), 6).alias("ratio"), F.round(sec * 1000 / F.col("n_frames"), 2).alias("ms_per_frame"), "n_stages")


def q_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select((F.col("event_id") % 997).alias("call_id"), F.when(F.col("event_id") % 997 < 500, F.lit("a")).otherwise(F.col("event_type")).alias("analysis_id"))
    return integrity(e, "call_id", "analysis_id").select("call_id", "n_analyses", F.coalesce("analysis_status", F.lit("-")).alias("analysis_status"), F.coalesce("parse_status", F.lit("-")).alias("parse_status"))


#: A status where one was stored, and a description that may carry the mark of a failure anywhere.
STORED_STATUS = "CASE WHEN value > 40 THEN 'failed' WHEN value > 30 THEN 'partial_failure' WHEN value > 20 THEN event_type END"
MARKED_TEXT = "CASE WHEN user_id % 3 = 0 THEN '[HATA] ' || event_type WHEN user_id % 3 = 1 THEN event_type || ' [HATA]' WHEN user_id % 4 <> 0 THEN event_type END"


def q_degraded(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", degraded_status(F.expr(STORED_STATUS), F.expr(MARKED_TEXT)).alias("status"))


def q_leaked_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    payload = F.when(F.col("event_id") % 5 == 0, '{"raw_response": "x", "a": {"image_bytes": 1}, "base64_image": ""}').when(F.col("event_id") % 5 == 1, "not json").otherwise(F.col("props"))
    return e.select("event_id", F.array_join(leaked_keys(payload), ",").alias("leaked"))


def q_client_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.when(F.col("value") < 125, "low").when(F.col("value") < 250, "mid").when(F.col("value") < 375, "high").otherwise("crit")
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", level.alias("level"), (F.floor(F.col("value") / 10) / 100).alias("confidence"))
    for by in ("time", "risk", "confidence"):
        e = client_order(e, "user_id", "level", by, "ts", "event_id", f"by_{by}")
    return e.select("event_id", *[F.col(f"by_{by}").cast("int").alias(f"by_{by}") for by in ("time", "risk", "confidence")])


def q_job_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry(table(spark, sf_dir, "events"), "user_id", [F.col("ts").desc(), F.col("event_id").desc()]).select("event_id", "user_id")


_LEVEL = "CASE WHEN value < 125 THEN 0 WHEN value < 250 THEN 1 WHEN value < 375 THEN 2 ELSE 3 END"
QUERIES = {f.__name__: f for f in (q_system_overview, q_stored_frames, q_referenced_frames, q_processing, q_integrity, q_degraded, q_leaked_keys, q_client_order, q_job_registry)}
ORACLE_SQL = {
    "q_system_overview": "SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS completed, count(*) FILTER (o_orderstatus = 'P') AS failed, count(*) FILTER (o_orderstatus NOT IN ('F', 'P')) AS running, count(*) FILTER (o_orderkey % 3 <> 0) AS with_trace, (SELECT count(DISTINCT conv_id) FROM conversations) AS n_conversations, (SELECT count(*) FROM conversations) AS n_messages FROM orders",
    "q_stored_frames": "SELECT event_id, CAST(CASE WHEN event_id % 11 <> 0 AND value < 250 THEN 2 ELSE 0 END AS BIGINT) AS n_frames FROM events",
    "q_referenced_frames": "SELECT event_id, 'f' || event_id AS frame_id FROM events WHERE event_id IN (SELECT unnest([event_id, event_id + 1, event_id + 7]) FROM events WHERE event_id % 11 <> 0)",
    "q_processing": """
WITH p AS (SELECT user_id, max(value) FILTER (user_id % 2 = 0) AS elapsed, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total_ms, max(epoch(ts)) - min(epoch(ts)) AS last_sec, count(*) AS n_frames, count(DISTINCT event_type) FILTER (value >= 100) AS n_stages FROM events GROUP BY user_id),
s AS (SELECT *, CASE WHEN elapsed > 0 THEN elapsed WHEN total_ms > 0 THEN total_ms / 1000 END AS sec FROM p)
SELECT user_id, round(sec, 3) AS processing_sec, round(sec / (last_sec + 5), 6) AS ratio, round(sec * 1000 / n_frames, 2) AS ms_per_frame, n_stages FROM s""",
    "q_integrity": """
WITH p AS (SELECT event_id % 997 AS call_id, count(DISTINCT CASE WHEN event_id % 997 < 500 THEN 'a' ELSE event_type END) AS n_analyses FROM events GROUP BY 1)
SELECT call_id, n_analyses, CASE WHEN n_analyses > 1 THEN 'partial' ELSE '-' END AS analysis_status, CASE WHEN n_analyses > 1 THEN 'provenance_integrity_failed' ELSE '-' END AS parse_status FROM p""",
    "q_degraded": f"WITH s AS (SELECT event_id, {STORED_STATUS} AS status, {MARKED_TEXT} AS text FROM events) SELECT event_id, CASE WHEN status IS NULL THEN CASE WHEN coalesce(starts_with(text, '[HATA]'), false) THEN 'failed' ELSE 'completed' END ELSE status END AS status FROM s",
    "q_leaked_keys": "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'base64_image,raw_response' ELSE '' END AS leaked FROM events",
    "q_client_order": f"""
SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS by_time, CAST(row_number() OVER (PARTITION BY user_id ORDER BY {_LEVEL} DESC, event_id) AS INTEGER) AS by_risk,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY floor(value / 10) DESC, event_id) AS INTEGER) AS by_confidence FROM events""",
    "q_job_registry": "SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events) WHERE back <= 50",
}
