"""What leaves the service: safe contexts, contract reports, frame metadata, badges and guarded texts; and inputs of other sources."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.functions.seams import embedder
from rillflow.functions.text import clock_truncated
from rillflow.functions.values import COMBINATION_RULES, MEAN_METHOD, NORMAL_UP_TO, OWN_METHOD, QUARANTINE
from rillflow.operators.risk import level_of
from rillflow.operators.rules import COMBO_CTE, TYPED_CTE, band_links, carrier_typed, match_combinations
from rillflow.operators.series import carrier_series, robust_spikes
from rillflow.operators.structured import shift
from rillflow.plans.lineage import materialize, shared_dir
from rillflow.plans.parameters import Spiking
from rillflow.session import table

#: What a context may show of an analysis; everything else, image bytes above all, stays inside.
SAFE_FIELDS = ("summary", "risk_score", "risk_level", "recommended_action", "actions", "detected_event_names", "detected_event_types", "escalation_tier", "auto_dispatched", "relevant_regulations")
SAFE_EVENT_FIELDS = ("event_name", "event_type", "keywords", "risk_level", "risk_score")


def _narrow(array: str, names: list[str]) -> Column:
    """An array of structs with some of its fields only, in a form that a scan reads no others for."""
    return F.arrays_zip(*[F.col(f"{array}.{name}").alias(name) for name in names])


def safe_context(analyses: DataFrame, key: str) -> DataFrame:
    """The key and one struct of what a reader may see: allowed fields, events and timeline reduced to theirs, evidence without images.

    Optional columns ``events``, ``timeline`` (timestamp, description) and
    ``evidence`` (timestamp, change_score) are arrays of structs; absent columns
    are absent in the context.  As this is a projection, a scan reads no other column.
    """
    has = set(analyses.columns)
    parts = [F.coalesce(F.nullif("summary", F.lit("")), "natural_language_summary").alias("summary") if c == "summary" and "natural_language_summary" in has else F.col(c) for c in SAFE_FIELDS if c in has]
    if "events" in has:
        inner = set(analyses.schema["events"].dataType.elementType.fieldNames())
        parts.append(_narrow("events", [c for c in SAFE_EVENT_FIELDS if c in inner]).alias("events"))
    if "timeline" in has:
        parts.append(F.transform(_narrow("timeline", ["timestamp", "description"]), lambda e: F.struct(clock_truncated(e["timestamp"]).alias("time"), e["description"].alias("event"))).alias("timeline"))
    if "evidence" in has:
        parts.append(F.transform(_narrow("evidence", ["timestamp", "change_score"]), lambda e: F.struct(clock_truncated(e["timestamp"]).alias("time"), F.round(e["change_score"], 4).alias("change_score"))).alias("evidence"))
    return analyses.select(key, F.struct(*parts).alias("context"))


def contract_report(analyses: DataFrame, key: str) -> DataFrame:
    """(key, report_json): the compact report of summary, onset, events in order of time, risk, how the score came about, and actions.

    Reads summary, natural_language_summary, onset, timeline (array of timestamp and
    description), risk_level, risk_score, risk_status, deterministic_score,
    deterministic_level, proposed_score, actions and recommended_action.  Fields that are null are written as null.
    """
    first = F.get("timeline", F.lit(0))["timestamp"]
    events = F.transform("timeline", lambda e: F.struct(clock_truncated(e["timestamp"]).alias("time"), e["description"].alias("event")))
    method = F.when(F.col("proposed_score").isNotNull(), MEAN_METHOD).otherwise(OWN_METHOD)
    accuracy = F.struct("deterministic_score", "deterministic_level", F.col("proposed_score").alias("llm_proposed_score"), F.col("risk_score").alias("final_score"), F.col("risk_level").alias("final_level"), method.alias("method"))
    spare = F.when(F.coalesce("recommended_action", F.lit("")) != "", F.array("recommended_action")).otherwise(F.array().cast("array<string>"))
    actions = F.when(F.size("actions") > 0, F.col("actions")).otherwise(spare)
    report = F.struct(
        F.coalesce(F.nullif("summary", F.lit("")), "natural_language_summary").alias("summary"), F.coalesce(F.nullif("onset", F.lit("")), F.when(first.isNotNull(), clock_truncated(first)), F.lit("00:00")).alias("onset_timestamp"),
        events.alias("events"), F.col("risk_level").alias("risk"), "risk_score", "risk_status", accuracy.alias("risk_accuracy"), actions.alias("actions"),
    )
    return analyses.select(key, F.to_json(report, {"ignoreNullFields": "false"}).alias("report_json"))


def frame_summary(frames: DataFrame, evidence_id: str, frame: str, at: str, score: str, reason: str) -> DataFrame:
    """A frame's metadata without its image."""
    return frames.select(F.col(evidence_id).alias("evidence_id"), F.col(frame).alias("frame_index"), F.col(at).alias("timestamp_sec"), F.col(score).alias("evidence_score"), F.col(reason).alias("selection_reason"))


def badge(level: Column, score: Column) -> Column:
    """``unknown`` without a score, ``normal`` up to 5 or for an unknown level, else the level."""
    known = level.isin("dusuk", "orta", "yuksek", "kritik")
    return F.when(score.isNull(), "unknown").when(score <= NORMAL_UP_TO, "normal").when(known, level).otherwise("normal")


def quarantined(text: Column, confidence: Column) -> Column:
    """The text behind a notice that it is data, with the guard's confidence to two places."""
    return F.format_string(QUARANTINE, confidence, text)


def normalized_keywords(raw: Column) -> Column:
    """Free-form terms stripped, without blank ones, each once in order of first sight; null is an empty list."""
    terms = F.coalesce(raw, F.array().cast("array<string>"))
    return F.array_distinct(F.filter(F.transform(terms, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x.isNotNull() & (x != "")))


def keywords_of(raw: Column, event_type: Column, found: Column) -> Column:
    """The free-form terms; where there are none and the type is known, the dictionary's words ``found`` in the text."""
    own = normalized_keywords(raw)
    return F.when((F.size(own) == 0) & event_type.isNotNull(), F.coalesce(found, F.array().cast("array<string>"))).otherwise(own)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Combination rules (rule_id, required, severity) of a JSON file, in place of the built-in ones; a broken file is an error."""
    return spark.read.schema("rule_id string, required array<string>, severity string").option("mode", "FAILFAST").json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Entries (clip_id, expected_types, max_seconds) of benchmark manifests: JSON lists, a file each; entries without a clip are left out."""
    return spark.read.schema("clip_id string, expected_types array<string>, max_seconds double").option("multiLine", True).json(path).filter("clip_id is not null")


def _analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An analysis for each user: its events by time and what a report holds, with bytes that must not leave."""
    s = carrier_series(spark, sf_dir).withColumn("cents", F.floor(F.col("value")).cast("int"))
    entry = F.struct(F.col("at_sec").alias("timestamp"), F.col("event_id").alias("event_id"), F.col("event_type").alias("description"))
    per = s.groupBy("user_id").agg(F.array_sort(F.collect_list(entry)).alias("timeline"), F.max("cents").alias("top"), F.count_if(F.col("event_type") == "error").alias("n_errors"))
    score = F.least(F.lit(100), F.floor(F.col("top") / 5)).cast("int")
    return per.select(
        "user_id", F.transform("timeline", lambda e: F.struct((e["timestamp"] % 3600).alias("timestamp"), e["description"].alias("description"))).alias("timeline"),
        F.when(F.col("user_id") % 3 == 0, "").otherwise(F.concat(F.lit("user "), F.col("user_id").cast("string"))).alias("summary"), F.lit("seen").alias("natural_language_summary"), F.lit(None).cast("string").alias("onset"),
        score.alias("risk_score"), level_of(score).alias("risk_level"), F.lit("known").alias("risk_status"), score.alias("deterministic_score"), level_of(score).alias("deterministic_level"),
        F.when(F.col("user_id") % 2 == 0, score).alias("proposed_score"), F.when(F.col("n_errors") > 3, F.array(F.lit("evacuate"), F.lit("call"))).otherwise(F.array().cast("array<string>")).alias("actions"),
        F.when(F.col("user_id") % 5 != 0, "watch").alias("recommended_action"), F.lit(b"image").alias("image_bytes"),
    )


def q_safe_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    context = safe_context(_analyses(spark, sf_dir), "user_id")
    return context.select("user_id", "context.summary", "context.risk_level", F.size("context.timeline").alias("n_entries"), F.array_join(F.transform("context.timeline", lambda e: F.concat_ws(" ", e["time"], e["event"])), "|").alias("entries"), F.array_join(F.json_object_keys(F.to_json("context")), ",").alias("fields"))


def q_contract_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contract_report(_analyses(spark, sf_dir), "user_id")


def q_frame_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = carrier_series(spark, sf_dir).select(F.concat(F.lit("ev"), F.col("event_id").cast("string")).alias("id"), "event_id", "at_sec", F.round("value", 4).alias("value"), "event_type", F.lit(b"image").alias("image_bytes"))
    return frame_summary(frames, "id", "event_id", "at_sec", "value", "event_type")


def q_badges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's badge, and its text behind the guard's notice where the guard is sure."""
    score = F.when(F.col("event_id") % 7 != 0, F.floor(F.col("value") / 5).cast("int"))
    e = table(spark, sf_dir, "events").select("event_id", "event_type", score.alias("score"), (F.floor(F.col("value")) / 500).alias("confidence"))
    level = F.when(F.col("event_type") != "view", level_of(F.col("score")))
    return e.select("event_id", badge(level, F.col("score")).alias("badge"), F.when(F.col("confidence") >= 0.5, quarantined(F.col("event_type"), F.col("confidence"))).otherwise(F.col("event_type")).alias("text"))


def q_shifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times within chunks of an hour as times of the whole, and the place of each row in the order of its start."""
    s = carrier_series(spark, sf_dir).withColumn("offset", F.floor(F.col("at_sec") / 3600) * 3600)
    inside = s.select("event_id", "offset", F.when(F.col("event_id") % 9 != 0, F.col("at_sec") - F.col("offset")).alias("start_sec"), F.when(F.col("event_id") % 4 != 0, F.col("at_sec") - F.col("offset") + 5).alias("end_sec"))
    return shift(inside, "offset").select("event_id", F.round("start_sec", 3).alias("start_sec"), F.round("end_sec", 3).alias("end_sec"))


def q_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 3 == 0, F.array(F.lit(" smoke "), F.col("event_type"), F.lit("smoke"), F.lit(" "), F.lit(None).cast("string"), F.col("event_type"))).when(F.col("event_id") % 3 == 1, F.array(F.lit("  ")))
    kind = F.when(F.col("event_type") != "view", F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(keywords_of(raw, kind, F.array(F.upper("event_type"))), "|").alias("keywords"))


def q_embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings of message texts, every fourth one blank: blank ones have none, the others have unit length."""
    text = F.when(F.col("turn") % 4 == 3, " ").otherwise(F.col("text"))
    vectors = table(spark, sf_dir, "conversations").select("conv_id", "turn", embedder()(text).alias("vector"))
    return vectors.select("conv_id", "turn", F.coalesce(F.size("vector"), F.lit(0)).alias("n_dims"), F.round(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)), 3).alias("length"))


def q_replaced_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Combinations by rules from a file that raises the severity of the built-in ones and drops the last."""
    path = f"{shared_dir(spark)}/rules-{uuid.uuid4().hex}"
    spark.createDataFrame([(a, list(b), "yuksek" if c == "kritik" else c) for a, b, c in COMBINATION_RULES[:-1]], "rule_id string, required array<string>, severity string").write.json(path)
    events = materialize(carrier_typed(spark, sf_dir), "events")
    links = band_links(events, ["video_id"], "event_id", "start_sec", "end_sec", 3600.0)
    return match_combinations(events, links, read_rules(spark, path)).select("rule_id", "severity", "source_id", F.array_join("participants", ",").alias("participants"))


def q_manifest_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests of benchmark items, written as JSON lists and read again."""
    path = f"{shared_dir(spark)}/manifests-{uuid.uuid4().hex}"
    b = table(spark, sf_dir, "benchmark")
    entry = F.struct(F.when(F.col("item_id") % 6 != 5, F.concat(F.lit("clip"), F.col("item_id").cast("string"))).alias("clip_id"), F.array(F.lit("a"), F.lit("b")).alias("expected_types"), (F.length("text") / 2).alias("max_seconds"))
    lists = b.groupBy((F.col("item_id") % 8).alias("part")).agg(F.to_json(F.collect_list(entry)).alias("value"))
    lists.repartition(8, "part").select("value").write.option("maxRecordsPerFile", 1).text(path)
    return read_manifest(spark, path).select("clip_id", F.size("expected_types").alias("n_types"), "max_seconds")


def q_configured_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spikes with parameters from a JSON file, checked before the job."""
    path = f"{shared_dir(spark)}/parameters-{uuid.uuid4().hex}"
    spark.createDataFrame([(2.5, 8)], Spiking.schema()).coalesce(1).write.json(path)
    return robust_spikes(carrier_series(spark, sf_dir), ["user_id"], "value", **Spiking.read(spark, path).values()).select("event_id", F.round("limit", 4).alias("limit"))


_SQL_LEVEL = "CASE WHEN {0} < 25 THEN 'dusuk' WHEN {0} < 50 THEN 'orta' WHEN {0} < 75 THEN 'yuksek' ELSE 'kritik' END"
_SQL_ANALYSES = f"""
s AS (SELECT event_id, user_id, epoch(ts) AS at_sec, event_type, CAST(floor(value) AS INTEGER) AS cents FROM events),
p AS (
  SELECT user_id, list({{'t': at_sec % 3600, 'd': event_type}} ORDER BY at_sec, event_id) AS timeline, CAST(least(100, floor(max(cents) / 5)) AS INTEGER) AS score, count(*) FILTER (event_type = 'error') AS n_errors FROM s GROUP BY user_id),
a AS (
  SELECT *, CASE WHEN user_id % 3 = 0 THEN 'seen' ELSE 'user ' || user_id END AS summary, {_SQL_LEVEL.format("score")} AS level,
    list_transform(timeline, lambda e: printf('%02d:%02d', CAST(floor(floor(e.t) / 60) AS BIGINT), CAST(floor(e.t) AS BIGINT) % 60)) AS times FROM p)"""
QUERIES = {f.__name__: f for f in (q_safe_context, q_contract_report, q_frame_summary, q_badges, q_shifted, q_keywords, q_embedded, q_replaced_rules, q_manifest_entries, q_configured_spikes)}
ORACLE_SQL = {
    "q_safe_context": f"""WITH {_SQL_ANALYSES}
SELECT user_id, summary, level AS risk_level, CAST(len(timeline) AS INTEGER) AS n_entries, array_to_string(list_transform(range(1, len(times) + 1), lambda k: times[k] || ' ' || timeline[k].d), '|') AS entries,
  'summary,risk_score,risk_level,' || CASE WHEN user_id % 5 <> 0 THEN 'recommended_action,' ELSE '' END || 'actions,timeline' AS fields FROM a""",
    "q_contract_report": f"""WITH {_SQL_ANALYSES}
SELECT user_id, '{{"summary":"' || summary || '","onset_timestamp":"' || times[1] || '","events":[' || array_to_string(list_transform(range(1, len(times) + 1), lambda k: '{{"time":"' || times[k] || '","event":"' || timeline[k].d || '"}}'), ',')
  || ']' || ',"risk":"' || level || '","risk_score":' || score || ',"risk_status":"known","risk_accuracy":{{"deterministic_score":' || score || ',"deterministic_level":"' || level || '","llm_proposed_score":' || CASE WHEN user_id % 2 = 0 THEN CAST(score AS VARCHAR) ELSE 'null' END
  || ',"final_score":' || score || ',"final_level":"' || level || '","method":"' || CASE WHEN user_id % 2 = 0 THEN '{MEAN_METHOD}' ELSE '{OWN_METHOD}' END || '"}},"actions":' || CASE WHEN n_errors > 3 THEN '["evacuate","call"]' WHEN user_id % 5 <> 0 THEN '["watch"]' ELSE '[]' END || '}}' AS report_json FROM a""",
    "q_frame_summary": "SELECT 'ev' || event_id AS evidence_id, event_id AS frame_index, epoch(ts) AS timestamp_sec, round(value, 4) AS evidence_score, event_type AS selection_reason FROM events",
    "q_badges": f"""
WITH e AS (SELECT event_id, event_type, CASE WHEN event_id % 7 <> 0 THEN CAST(floor(value / 5) AS INTEGER) END AS score, floor(value) / 500 AS confidence FROM events)
SELECT event_id, CASE WHEN score IS NULL THEN 'unknown' WHEN score <= 5 OR event_type = 'view' THEN 'normal' ELSE {_SQL_LEVEL.format("score")} END AS badge,
  CASE WHEN confidence >= 0.5 THEN printf('{QUARANTINE.replace("'", "''")}', confidence, event_type) ELSE event_type END AS text FROM e""",
    "q_shifted": """
SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN round(epoch(ts), 3) END AS start_sec, CASE WHEN event_id % 4 <> 0 THEN round(epoch(ts) + 5, 3) END AS end_sec FROM events""",
    "q_keywords": """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'smoke|' || event_type WHEN event_type <> 'view' THEN upper(event_type) ELSE '' END AS keywords FROM events""",
    "q_embedded": "SELECT conv_id, turn, CASE WHEN turn % 4 = 3 OR trim(text) = '' THEN 0 ELSE 16 END AS n_dims, CASE WHEN turn % 4 = 3 OR trim(text) = '' THEN NULL ELSE 1.0 END AS length FROM conversations",
    "q_replaced_rules": f"WITH {TYPED_CTE}, {COMBO_CTE} SELECT rule_id, CASE severity WHEN 'kritik' THEN 'yuksek' ELSE severity END AS severity, source_id, array_to_string(participants, ',') AS participants FROM combos WHERE rule_id <> 'COMBO-05'",
    "q_manifest_entries": "SELECT 'clip' || item_id AS clip_id, 2 AS n_types, length(text) / 2 AS max_seconds FROM benchmark WHERE item_id % 6 <> 5",
    "q_configured_spikes": """WITH s AS (SELECT event_id, user_id, value FROM events), c AS (SELECT user_id, median(value) AS center, count(*) AS n FROM s GROUP BY user_id),
m AS (SELECT user_id, any_value(n) AS n, any_value(center) AS center, median(abs(value - center)) AS mad FROM s JOIN c USING (user_id) GROUP BY user_id)
SELECT event_id, round(center + 2.5 * CASE WHEN mad = 0 THEN 1e-6 ELSE mad END, 4) AS "limit" FROM s JOIN m USING (user_id) WHERE n >= 8 AND value > center + 2.5 * CASE WHEN mad = 0 THEN 1e-6 ELSE mad END""",
}
