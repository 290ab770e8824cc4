"""Analytics over JSON execution traces, indicators and usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillflow.operators.sessions import seconds
from rillflow.session import table

STAGES = (("click", "events"), ("purchase", "report"), ("error", "rag_security"), ("signup", "sampler"), ("view", "vlm"))


def explode_trace(jobs: DataFrame, trace: str) -> DataFrame:
    """One row per trace event: pos, stage, duration_ms, data.  A trace that is null or does not parse gives no rows."""
    parsed = jobs.withColumn("__items", F.expr(f"try_variant_get(try_parse_json({trace}), '$', 'array<variant>')"))
    items = parsed.select(*[c for c in jobs.columns if c != trace], F.posexplode("__items").alias("pos", "item"))
    get = lambda path, kind: F.expr(f"try_variant_get(item, '$.{path}', '{kind}')")
    return items.withColumn("stage", get("stage", "string")).withColumn("duration_ms", get("duration_ms", "double")).withColumn("data", F.expr("try_variant_get(item, '$.data', 'variant')")).drop("item")


def one_per_stage(events: DataFrame, job: str, last: bool = False) -> DataFrame:
    """The first (or last) event of every stage of a job."""
    order = F.col("pos").desc() if last else F.col("pos").asc()
    w = Window.partitionBy(job, "stage").orderBy(order)
    return events.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def stage_durations(events: DataFrame, job: str, at: str) -> DataFrame:
    """Milliseconds since the job's previous event; null for the first."""
    w = Window.partitionBy(job).orderBy("pos")
    return events.withColumn("since_ms", (F.col(at) - F.lag(at).over(w)) * 1000)


def overview(events: DataFrame, job: str) -> DataFrame:
    """One row over all jobs, from the first event of every stage; means are null where nothing was measured."""
    data = lambda path, kind: F.expr(f"try_variant_get(data, '$.{path}', '{kind}')")
    is_ = lambda stage: F.col("stage") == stage
    latency = F.avg(F.when(is_("rag_security"), data("latency_ms", "double")))
    return one_per_stage(events, job).agg(
        F.countDistinct(job).alias("n_jobs"),
        F.coalesce(F.sum(F.when(is_("events"), data("n", "long"))), F.lit(0)).alias("n_detected"),
        F.count_if(is_("report") & (data("level", "string") == "kritik")).alias("n_critical"),
        F.count_if(is_("rag_security")).alias("n_retrievals"),
        F.count_if(is_("rag_security") & (data("n", "long") == 0)).alias("n_zero_results"),
        F.count_if(is_("rag_security") & (data("action", "string") == "quarantine")).alias("n_quarantined"),
        F.round(latency, 1).alias("mean_latency_ms"),
    )


def status_counts(jobs: DataFrame, status: str) -> DataFrame:
    """Counts by status; running is what is neither completed nor failed."""
    n = lambda s: F.count_if(F.col(status) == s)
    return jobs.agg(F.count("*").alias("total"), n("completed").alias("completed"), n("failed").alias("failed"), (F.count("*") - n("completed") - n("failed")).alias("running"))


def share_of(checks: list[Column]) -> Column:
    """Percentage of checks that hold; a null check does not hold."""
    return 100.0 * sum((F.coalesce(c, F.lit(False)).cast("int") for c in checks), F.lit(0)) / len(checks)


def usage(events: DataFrame, category: str) -> DataFrame:
    """Calls, estimated tokens, duration and mean latency by category.  Nothing is filled in for what was not measured."""
    return events.groupBy(category).agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), F.round(F.sum("duration_ms"), 2).alias("duration_ms"), F.round(F.avg("duration_ms"), 2).alias("mean_ms"))


def stage_name(event_type: Column) -> Column:
    out = F.lit(None).cast("string")
    for key, value in STAGES:
        out = F.when(event_type == key, value).otherwise(out)
    return out


def carrier_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON trace for every user from their events in time order."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    item = F.struct(
        seconds(F.col("ts")).alias("at"), stage_name(F.col("event_type")).alias("stage"), F.round("value", 2).alias("duration_ms"),
        F.struct(k.alias("n"), F.when(F.col("value") >= 375, "kritik").otherwise("orta").alias("level"), F.when(k % 3 == 0, "quarantine").otherwise("allow").alias("action"), F.round("value", 2).alias("latency_ms")).alias("data"),
    )
    return e.groupBy("user_id").agg(F.to_json(F.array_sort(F.collect_list(item))).alias("trace_json"))


def carrier_trace_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_trace(carrier_traces(spark, sf_dir), "trace_json")


def q_trace_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview(carrier_trace_events(spark, sf_dir), "user_id")


def q_first_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one_per_stage(carrier_trace_events(spark, sf_dir), "user_id").select("user_id", "stage", "pos", F.round("duration_ms", 2).alias("duration_ms"))


def q_last_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one_per_stage(carrier_trace_events(spark, sf_dir), "user_id", last=True).select("user_id", "stage", "pos", F.round("duration_ms", 2).alias("duration_ms"))


def q_stage_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", seconds(F.col("ts")).alias("at_sec"))
    e = e.withColumn("pos", F.row_number().over(Window.partitionBy("user_id").orderBy("at_sec")) - 1)
    return stage_durations(e, "user_id", "at_sec").select("event_id", "pos", F.coalesce(F.round("since_ms", 0), F.lit(-1.0)).cast("long").alias("since_ms"))


def q_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detection, completeness, consistency, capture and time indicators of every user."""
    e = table(spark, sf_dir, "events")
    types = lambda c: F.countDistinct(F.when(c, F.col("event_type")))
    per = e.groupBy("user_id").agg(
        F.round(F.avg(F.least(F.lit(1.0), F.col("value") / 100).cast("decimal(18,6)")).cast("double") * 100, 3).alias("detection"),
        types(F.col("value") >= 375).alias("critical_types"), types(F.col("value") >= 50).alias("detected_types"),
        F.round(F.sum(F.col("value").cast("decimal(18,4)")).cast("double") / 1000, 4).alias("processing_sec"),
        *[F.max(F.col("event_type") == t).alias(t) for t, _ in STAGES], F.count("*").alias("n"), F.max("value").alias("top"),
    )
    complete = share_of([*[F.col(t) for t, _ in STAGES], F.col("n") >= 80, F.col("top") > 100])
    critical = F.col("top") >= 70
    consistent = share_of([F.col("purchase"), F.col("n") > 0, F.col("signup"), F.when(critical, F.col("click") | F.col("view")).otherwise(F.col("signup")), F.when(critical, F.col("error")).otherwise(F.lit(True))])
    capture = F.when(F.col("detected_types") > 0, F.least(F.lit(100.0), 100.0 * F.col("critical_types") / F.col("detected_types"))).otherwise(-1.0)
    return per.select("user_id", "detection", F.round(complete, 3).alias("completeness"), F.round(consistent, 3).alias("consistency"), F.round(capture, 3).alias("capture"), "processing_sec")


def q_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(stage_name(F.col("event_type")).alias("stage"), F.ceil(F.length("props") / 3).alias("tokens"), F.col("value").cast("decimal(18,4)").alias("duration_ms"))
    u = usage(e, "stage")
    return u.select("stage", "calls", "tokens", F.col("duration_ms").cast("double").alias("duration_ms"), F.round(F.col("mean_ms").cast("double"), 2).alias("mean_ms"))


_EVENTS = """t AS (
  SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS pos, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
    CASE event_type WHEN 'click' THEN 'events' WHEN 'purchase' THEN 'report' WHEN 'error' THEN 'rag_security' WHEN 'signup' THEN 'sampler' ELSE 'vlm' END AS stage, epoch(ts) AS at_sec
  FROM events)"""
_ONE = "SELECT user_id, stage, CAST(pos AS INTEGER) AS pos, round(value, 2) AS duration_ms FROM (SELECT *, row_number() OVER (PARTITION BY user_id, stage ORDER BY pos {0}) AS n FROM t) WHERE n = 1"
QUERIES = {f.__name__: f for f in (q_trace_overview, q_first_stage, q_last_stage, q_stage_durations, q_kpis, q_usage)}
ORACLE_SQL = {
    "q_trace_overview": f"""WITH {_EVENTS}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, stage ORDER BY pos) AS n FROM t) WHERE n = 1)
SELECT count(DISTINCT user_id) AS n_jobs, CAST(coalesce(sum(k) FILTER (stage = 'events'), 0) AS BIGINT) AS n_detected, count(*) FILTER (stage = 'report' AND value >= 375) AS n_critical, count(*) FILTER (stage = 'rag_security') AS n_retrievals,
  count(*) FILTER (stage = 'rag_security' AND k = 0) AS n_zero_results, count(*) FILTER (stage = 'rag_security' AND k % 3 = 0) AS n_quarantined, round(avg(round(value, 2)) FILTER (stage = 'rag_security'), 1) AS mean_latency_ms FROM f""",
    "q_first_stage": f"WITH {_EVENTS} " + _ONE.format("ASC"),
    "q_last_stage": f"WITH {_EVENTS} " + _ONE.format("DESC"),
    "q_stage_durations": f"WITH {_EVENTS} SELECT event_id, CAST(pos AS INTEGER) AS pos, CAST(coalesce(round((at_sec - lag(at_sec) OVER (PARTITION BY user_id ORDER BY pos)) * 1000, 0), -1) AS BIGINT) AS since_ms FROM t",
    "q_kpis": """
WITH p AS (SELECT user_id, round(CAST(sum(CAST(least(1.0, value / 100) AS DECIMAL(18,6))) AS DOUBLE) / count(*) * 100, 3) AS detection, count(DISTINCT event_type) FILTER (value >= 375) AS c, count(DISTINCT event_type) FILTER (value >= 50) AS d,
  round(CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) / 1000, 4) AS processing_sec, bool_or(event_type = 'click') AS click, bool_or(event_type = 'purchase') AS purchase, bool_or(event_type = 'error') AS error, bool_or(event_type = 'signup') AS signup, bool_or(event_type = 'view') AS "view", count(*) AS n, max(value) AS top FROM events GROUP BY user_id)
SELECT user_id, detection, round(100.0 * (CAST(click AS INTEGER) + CAST(purchase AS INTEGER) + CAST(error AS INTEGER) + CAST(signup AS INTEGER) + CAST("view" AS INTEGER) + CAST(n >= 80 AS INTEGER) + CAST(top > 100 AS INTEGER)) / 7, 3) AS completeness,
  round(100.0 * (CAST(purchase AS INTEGER) + 1 + CAST(signup AS INTEGER) + CAST(CASE WHEN top >= 70 THEN click OR "view" ELSE signup END AS INTEGER) + CAST(CASE WHEN top >= 70 THEN error ELSE true END AS INTEGER)) / 5, 3) AS consistency,
  round(CASE WHEN d > 0 THEN least(100.0, 100.0 * c / d) ELSE -1.0 END, 3) AS capture, processing_sec FROM p""",
    "q_usage": f"WITH {_EVENTS}, u AS (SELECT t.stage, ceil(length(e.props) / 3) AS tokens, CAST(e.value AS DECIMAL(18,4)) AS v FROM t JOIN events e USING (event_id)) SELECT stage, count(*) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens, round(CAST(sum(v) AS DOUBLE), 2) AS duration_ms, round(CAST(sum(v) AS DOUBLE) / count(*), 2) AS mean_ms FROM u GROUP BY stage",
}
