"""What follows from a model's reply: confirmed spikes, classification with an undecided outcome, reconciled batches, fallback lines and labels."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.functions.seams import pair_scorer, rerank
from rillflow.functions.text import strip
from rillflow.functions.values import ACTION_LINE, EVENT_TYPES, EVIDENCE_LABEL, NO_BATCH, RISK_LINE, SPIKE_HALF_SEC, SPIKE_NAME, SPIKE_TEXT, SUFFIX, UNDECIDED
from rillflow.session import table


def _of(raw: Column, path: str, kind: str) -> Column:
    """A field of a reply's JSON object, from its first brace to its last; null where it is missing or of another kind."""
    inner = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    return F.try_variant_get(F.try_parse_json(F.when(inner != "", inner).otherwise(raw)), f"$.{path}", kind)


def _share(value: Column, missing: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(value, F.lit(missing))))


def confirmed_spikes(candidates: DataFrame, at: str, reply: str) -> DataFrame:
    """Event rows of the candidates whose reply calls them notable; a reply that is missing or does not parse confirms nothing."""
    name = F.coalesce(F.nullif(strip(_of(F.col(reply), "event_name", "string")), F.lit("")), F.lit(SPIKE_NAME))
    text = F.coalesce(F.nullif(strip(_of(F.col(reply), "description", "string")), F.lit("")), F.lit(SPIKE_TEXT))
    good = candidates.filter(F.coalesce(_of(F.col(reply), "is_notable_event", "boolean"), F.lit(False)))
    return (
        good.withColumn("event_name", name).withColumn("description", text).withColumn("confidence", _share(_of(F.col(reply), "confidence", "double"), 0.5))
        .withColumn("start_sec", F.greatest(F.lit(0.0), F.col(at) - SPIKE_HALF_SEC)).withColumn("end_sec", F.col(at) + SPIKE_HALF_SEC)
        .withColumn("keywords", F.array("event_name")).withColumn("evidence_ids", F.array().cast("array<string>"))
    )


def classified(rows: DataFrame, reply: str, model: str, types: tuple[str, ...] = EVENT_TYPES, suffix: str = SUFFIX) -> DataFrame:
    """Add event_name, event_type, confidence and source_model from a classifier's reply.

    A reply that fails, does not parse or names no known type is undecided: it
    has no type and is never taken for an observation without risk.
    """
    kind = F.lower(strip(_of(F.col(reply), "event_type", "string")))
    known = F.coalesce(kind.isin(*types), F.lit(False))
    return (
        rows.withColumn("event_type", F.when(known, kind)).withColumn("event_name", F.when(known, kind).otherwise(UNDECIDED))
        .withColumn("confidence", F.when(known, _share(_of(F.col(reply), "confidence", "double"), 0.3)).otherwise(0.0))
        .withColumn("source_model", F.concat(F.col(model), F.when(known, suffix).otherwise(suffix + "_failed")))
    )


def reconcile_batches(batches: DataFrame, key: str, order: str) -> DataFrame:
    """One reply of an analysis from its batches (failed, text, n_frames, latency_ms, ids, event_ids), without a model.

    The evidence of all batches is united, that of failed ones too, then that of
    the events of the batches that did not fail; those are numbered through.  An
    analysis without a good batch has failed.  A group is one analysis' batches.
    """
    good = ~F.col("failed")
    rows = F.array_sort(F.collect_list(F.struct(order, "failed", "text", "ids", "event_ids")))
    pooled = batches.groupBy(key).agg(rows.alias("rows"), F.sum(F.when(good, F.col("n_frames")).otherwise(0)).alias("n_frames"), F.sum(F.when(good, F.col("latency_ms")).otherwise(0)).alias("latency_ms"))
    ok = F.filter("rows", lambda r: ~r["failed"])
    events = F.flatten(F.transform(ok, lambda r: r["event_ids"]))
    united = F.array_distinct(F.concat(F.flatten(F.transform("rows", lambda r: r["ids"])), events))
    return pooled.select(
        key, F.when(F.size(ok) > 0, "ok").otherwise("failed").alias("status"), F.when(F.size(ok) > 0, F.get(ok, F.lit(0))["text"]).otherwise(NO_BATCH).alias("text"), "n_frames", "latency_ms",
        united.alias("evidence_ids"), F.transform(events, lambda _, k: F.concat(F.lit("mock_e"), (k + 1).cast("string"))).alias("event_names"),
    )


def risk_source(status: Column, n_rules: Column) -> Column:
    """Where a risk level comes from: nowhere if the analysis did not finish, else from the rules that matched, else from the model."""
    return F.when(status == "unknown", "unknown").when(n_rules > 0, "rule_engine").otherwise("agent")


def fallback_risk(text: Column) -> Column:
    """The score of a risk line in a reply that is no JSON, held within 0 to 100; null without one."""
    found = F.regexp_extract(text, RISK_LINE, 1)
    return F.when(found != "", F.least(F.lit(100), found.cast("int")))


def fallback_action(text: Column) -> Column:
    """The text of an action line; null without one."""
    return F.nullif(strip(F.regexp_extract(text, ACTION_LINE, 1)), F.lit(""))


def evidence_label(evidence_id: Column, frame_index: Column, clock: Column, at_sec: Column, score: Column, reason: Column) -> Column:
    """The label that stands beside a frame in a model's input."""
    return F.format_string(EVIDENCE_LABEL, evidence_id, frame_index, clock, at_sec, score, reason)


# Replies and texts that differ from event to event, as expressions that Spark and DuckDB read alike; a third of the replies is cut short.
_CUT = "substring({0}, 1, CAST(length({0}) - CASE WHEN event_id % 3 = 0 THEN event_id % 40 ELSE 0 END AS INT))"
_SHARE = "CASE WHEN user_id % 4 = 1 THEN '\"high\"' ELSE CAST(CAST(floor(value * 5) AS BIGINT) - 9 AS STRING) || 'e-2' END"
_PAD = "repeat(' ', CAST(user_id % 6 AS INT))"
SPIKE_REPLY = _CUT.format(
    f"""('so: {{"is_notable_event": ' || CASE WHEN value > 8 THEN 'true' ELSE 'false' END || ', "event_name": "' || {_PAD} || CASE WHEN value > 16 THEN event_type ELSE '' END
    || '", "confidence": ' || {_SHARE} || CASE WHEN user_id % 7 < 5 THEN ', "description": "user ' || CAST(user_id AS STRING) || '"' ELSE '' END || '}} end')"""
)
CLASS_REPLY = _CUT.format(
    f"""('is {{"event_type": "' || {_PAD} || CASE WHEN value > 24 THEN 'Yangin_Duman' WHEN value > 12 THEN 'genel_gozlem' ELSE event_type END || ' ", "confidence": ' || {_SHARE} || '}} end')"""
)
LINES = f"""('seen' || chr(10) || CASE WHEN user_id % 2 = 0 THEN 'RISK_SKORU:' ELSE '"Risk_Score"=' END || {_PAD} || CAST(CAST(floor(value * 7) AS BIGINT) AS STRING) || chr(10)
  || CASE WHEN value > 10 THEN 'Aksiyon_Onerisi:' || {_PAD} || CASE WHEN value > 20 THEN 'stop ' || event_type ELSE '' END || ' ' || chr(10) || 'more' ELSE '' END)"""


def q_confirmed_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 7 / 4).alias("at_sec"), F.expr(SPIKE_REPLY).alias("reply"))
    return confirmed_spikes(rows, "at_sec", "reply").select("event_id", "event_name", "description", "confidence", "start_sec", "end_sec", F.array_join("keywords", ",").alias("keywords"))


def q_classifier_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.expr(CLASS_REPLY).alias("reply"), F.lit("m").alias("model"))
    return classified(rows, "reply", "model").select("event_id", "event_name", F.coalesce("event_type", F.lit("-")).alias("event_type"), "confidence", "source_model")


def q_reconcile_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    ids = lambda *xs: F.array(*[F.concat(F.lit("e"), x.cast("string")) for x in xs])
    half = F.floor(F.col("turn") / 2)
    rows = c.select("conv_id", "turn", (F.col("turn") % 4 != 1).alias("failed"), F.concat(F.lit("t"), F.col("turn").cast("string")).alias("text"), (F.col("turn") + 1).alias("n_frames"), (F.col("turn") * 2).alias("latency_ms"), ids(F.col("turn"), half).alias("ids"), ids(F.col("turn") + 100).alias("event_ids"))
    return reconcile_batches(rows.dropDuplicates(["conv_id", "turn"]), "conv_id", "turn").withColumn("evidence_ids", F.array_join("evidence_ids", ",")).withColumn("event_names", F.array_join("event_names", ","))


def q_fallback_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr(LINES)
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(fallback_risk(text), F.lit(-1)).alias("risk"), F.coalesce(fallback_action(text), F.lit("-")).alias("action"))


def q_evidence_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", evidence_label(F.concat(F.lit("ev"), F.col("event_id").cast("string")), F.col("event_id"), F.lit("00:01"), F.col("event_id") % 400 / F.lit(4.0), F.col("event_id") % 16 / F.lit(16.0), F.col("event_type")).alias("label"))


def q_risk_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", risk_source(F.when(F.col("event_id") % 5 == 0, "unknown").when(F.col("event_id") % 5 == 1, "ok"), F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 3 - 1)).alias("risk_source"))


RERANK_QUERY = "The terms of the license and the version of this work"


def _shared_words(pairs: list[tuple[str, str]]) -> list[float]:
    """Words that two texts share, as a part of all words of both."""
    sets = [(set(re.findall("[A-Za-z0-9]+", a)), set(re.findall("[A-Za-z0-9]+", b))) for a, b in pairs]
    return [len(a & b) / (len(a | b) or 1) for a, b in sets]


def q_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents that share most words with a query, by a scorer of pairs where a model would stand; previous order for ties."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rerank(docs, F.lit(RERANK_QUERY), F.col("text"), pair_scorer(lambda: _shared_words), "doc_id", 10).select("doc_id", "pair_score")


QUERIES = {f.__name__: f for f in (q_confirmed_spikes, q_classifier_fallback, q_reconcile_batches, q_fallback_lines, q_evidence_labels, q_risk_source, q_rerank)}
_DOC_SQL = """d AS (SELECT event_id, CASE WHEN json_valid(x) THEN x END AS doc FROM (SELECT event_id, coalesce(nullif(regexp_extract(reply, '\\{{.*\\}}', 0, 's'), ''), reply) AS x FROM (SELECT *, {} AS reply FROM events)))"""
ORACLE_SQL = {
    "q_confirmed_spikes": f"""
WITH {_DOC_SQL.format(SPIKE_REPLY)},
p AS (SELECT event_id, event_id % 7 / 4 AS t, coalesce(nullif(trim(json_extract_string(doc, '$.event_name')), ''), '{SPIKE_NAME}') AS n, coalesce(nullif(trim(json_extract_string(doc, '$.description')), ''), '{SPIKE_TEXT}') AS description,
  coalesce(TRY_CAST(json_extract_string(doc, '$.confidence') AS DOUBLE), 0.5) AS c FROM d WHERE json_extract_string(doc, '$.is_notable_event') = 'true')
SELECT event_id, n AS event_name, description, CAST(greatest(0, least(1, c)) AS DOUBLE) AS confidence, CAST(greatest(0, t - 0.5) AS DOUBLE) AS start_sec, CAST(t + 0.5 AS DOUBLE) AS end_sec, n AS keywords FROM p""",
    "q_classifier_fallback": f"""
WITH {_DOC_SQL.format(CLASS_REPLY)},
k AS (SELECT event_id, lower(trim(json_extract_string(doc, '$.event_type'))) AS kind, coalesce(TRY_CAST(json_extract_string(doc, '$.confidence') AS DOUBLE), 0.3) AS c FROM d),
n AS (SELECT event_id, CASE WHEN kind IN ({", ".join(f"'{t}'" for t in EVENT_TYPES)}) THEN kind END AS known, c FROM k)
SELECT event_id, coalesce(known, '{UNDECIDED}') AS event_name, coalesce(known, '-') AS event_type, CAST(CASE WHEN known IS NULL THEN 0 ELSE greatest(0, least(1, c)) END AS DOUBLE) AS confidence, 'm{SUFFIX}' || CASE WHEN known IS NULL THEN '_failed' ELSE '' END AS source_model FROM n""",
    "q_reconcile_batches": f"""
WITH b AS (SELECT DISTINCT conv_id, turn, turn % 4 <> 1 AS failed FROM conversations),
i AS (SELECT conv_id, unnest(['e' || turn, 'e' || turn // 2]) AS id, 0 AS part, turn, unnest([0, 1]) AS k FROM b UNION ALL SELECT conv_id, 'e' || (turn + 100), 1, turn, 0 FROM b WHERE NOT failed),
u AS (SELECT conv_id, id, min([part, turn, k]) AS place FROM i GROUP BY conv_id, id),
e AS (SELECT conv_id, string_agg(id, ',' ORDER BY place) AS evidence_ids FROM u GROUP BY conv_id),
g AS (SELECT conv_id, count(*) FILTER (NOT failed) AS n_good, arg_min('t' || turn, turn) FILTER (NOT failed) AS text, CAST(coalesce(sum(turn + 1) FILTER (NOT failed), 0) AS BIGINT) AS n_frames, CAST(coalesce(sum(turn * 2) FILTER (NOT failed), 0) AS BIGINT) AS latency_ms FROM b GROUP BY conv_id)
SELECT conv_id, CASE WHEN n_good > 0 THEN 'ok' ELSE 'failed' END AS status, coalesce(text, '{NO_BATCH}') AS text, n_frames, latency_ms, evidence_ids, array_to_string(list_transform(generate_series(1, n_good), lambda x: 'mock_e' || x), ',') AS event_names FROM g JOIN e USING (conv_id)""",
    "q_fallback_lines": f"""
WITH t AS (SELECT event_id, {LINES} AS x FROM events)
SELECT event_id, CASE WHEN regexp_matches(x, '{RISK_LINE}') THEN least(100, CAST(regexp_extract(x, '{RISK_LINE}', 1) AS INTEGER)) ELSE -1 END AS risk, coalesce(nullif(trim(regexp_extract(x, '{ACTION_LINE}', 1)), ''), '-') AS action FROM t""",
    "q_evidence_labels": "SELECT event_id, printf('[evidence_id=ev%d | frame_index=%d | zaman=00:01 (%.2fs) | evidence_skoru=%.4f | secim_nedeni=%s]', event_id, event_id, event_id % 400 / 4, event_id % 16 / 16, event_type) AS label FROM events",
    "q_risk_source": "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'unknown' WHEN event_id % 3 = 2 THEN 'rule_engine' ELSE 'agent' END AS risk_source FROM events",
    "q_rerank": f"""
WITH w AS (SELECT doc_id, list_distinct(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+')) AS t, list_distinct(string_split('{RERANK_QUERY}', ' ')) AS q FROM documents),
n AS (SELECT doc_id, len(list_intersect(t, q)) AS both_have, len(t) + len(q) AS n_words FROM w)
SELECT doc_id, CAST(both_have AS DOUBLE) / (n_words - both_have) AS pair_score FROM n ORDER BY pair_score DESC, doc_id LIMIT 10""",
}
