"""Folding sessions into structured events, projections of them, and the small joins around a report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillflow.functions.text import clock, strip
from rillflow.operators.risk import level_of
from rillflow.operators.rules import canonical_type
from rillflow.operators.sessions import SESSIONS_CTE, carrier_events, number_sessions, seconds
from rillflow.session import table

GUARD_FROM = 0.80
SEMANTIC_CHARS = 200
FOLD_SEC = 3600.0
EXPANSIONS = (("click", "personal protective equipment"), ("purchase", "vehicle pedestrian distance"), ("error", "fire and smoke"))


def ordered_union(arrays: Column, order: Column) -> Column:
    """Aggregate: the distinct elements of all rows' arrays, in order of first sight; null arrays count as empty."""
    rows = F.array_sort(F.collect_list(F.when(arrays.isNotNull(), F.struct(order.alias("o"), arrays.alias("a")))))
    return F.array_distinct(F.flatten(F.transform(rows, lambda r: r["a"])))


def fold_sessions(numbered: DataFrame, keys: list[str], at: str, tie: str, part_sec: float = FOLD_SEC) -> DataFrame:
    """One temporal event per session of (event_name, event_type, end_sec, confidence, description, keywords, evidence_ids, risk_hint).

    Start is the earliest time and end that of the latest row; name and
    description are the latest row's, the type is the latest one known; lists are
    united in order; confidence is the highest plus 0.05 for each further row.

    Sessions are folded in parts of ``part_sec`` seconds first, so a session of
    very many rows is spread over tasks and only distinct elements of each part's
    lists meet.  Rows with a null time come first; an empty table gives an empty result.
    """
    order = F.struct(at, tie)
    latest = lambda c: F.max_by(c, order)
    part = F.coalesce(F.floor(F.col(at) / part_sec), F.lit(-(1 << 62))).alias("part")
    parts = numbered.groupBy(*keys, "session_no", part).agg(
        F.min(at).alias("low"), F.max(order).alias("last"), F.count("*").alias("n"), F.max("confidence").alias("high"),
        latest(F.coalesce(F.col("end_sec"), F.col(at))).alias("end_sec"), latest(F.col("description")).alias("description"),
        F.max(F.when(F.col("event_type").isNotNull(), F.struct(order.alias("order"), "event_type"))).alias("typed"),
        ordered_union(F.col("keywords"), order).alias("keywords"), ordered_union(F.col("evidence_ids"), order).alias("evidence_ids"), F.max("risk_hint").alias("risk_hint"),
    )
    folded = parts.groupBy(*keys, "session_no").agg(
        F.min("low").alias("start_sec"), F.max_by("end_sec", "last").alias("end_sec"), F.sum("n").alias("occurrence_count"),
        F.least(F.lit(1.0), F.max("high") + 0.05 * (F.sum("n") - 1)).alias("confidence"), F.max_by("description", "last").alias("description"),
        F.max("typed")["event_type"].alias("event_type"),
        ordered_union(F.col("keywords"), F.col("part")).alias("keywords"), ordered_union(F.col("evidence_ids"), F.col("part")).alias("evidence_ids"), F.max("risk_hint").alias("risk_hint"),
    )
    return folded.withColumn("duration", F.greatest(F.lit(0.0), F.col("end_sec") - F.col("start_sec")))


def widen_by_evidence(events: DataFrame, frames: DataFrame, event_id: str) -> DataFrame:
    """Events whose interval also covers the times of their evidence frames; an end before the start counts as the start."""
    spread = events.select(event_id, F.explode("evidence_ids").alias("evidence_id"))
    spans = spread.join(frames.select("evidence_id", "frame_sec"), "evidence_id").groupBy(event_id).agg(F.min("frame_sec").alias("__low"), F.max("frame_sec").alias("__high"))
    end = F.when(F.col("end_sec") < F.col("start_sec"), F.col("start_sec")).otherwise(F.col("end_sec"))
    joined = events.withColumn("end_sec", end).join(spans, event_id, "left")
    wide = F.when(F.col("end_sec").isNotNull(), F.greatest("end_sec", "__high"))
    return joined.withColumn("start_sec", F.least("start_sec", "__low")).withColumn("end_sec", wide).drop("__low", "__high")


def shift(rows: DataFrame, offset: str) -> DataFrame:
    """Chunk-relative times as times of the whole video; null times stay null."""
    return rows.withColumn("start_sec", F.col("start_sec") + F.col(offset)).withColumn("end_sec", F.col("end_sec") + F.col(offset))


def describe(name: Column, description: Column, count: Column, rules: Column) -> Column:
    """Description line: text, a note on repetition, and the matched rules."""
    return F.concat_ws(" ", F.coalesce(F.nullif(strip(description), F.lit("")), name), F.when(count > 1, F.format_string("(seen %d times)", count)), F.when(F.size(rules) > 0, F.concat(F.lit("["), F.array_join(rules, " | "), F.lit("]"))))


def with_fallback(primary: DataFrame, fallback: DataFrame, key: str) -> DataFrame:
    """Primary rows, and the fallback rows of keys that have no primary row."""
    return primary.unionByName(fallback.join(primary.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def guard(is_injection: Column, confidence: Column, failed: Column, least: float = GUARD_FROM) -> Column:
    """Quarantine sure injections; a guard that failed or did not answer closes."""
    closed = F.coalesce(failed, F.lit(True)) | is_injection.isNull() | confidence.isNull()
    return F.when(closed, "quarantine").when(is_injection & (confidence >= least), "quarantine").otherwise("allow")


def semantic_query(keywords: Column, text: Column) -> Column:
    """Expanded keywords and the text's first characters, joined; null without keywords."""
    known = F.create_map(*[F.lit(x) for pair in EXPANSIONS for x in pair])
    expanded = F.transform(keywords, lambda k: F.coalesce(F.try_element_at(known, k), F.replace(k, F.lit("_"), F.lit(" "))))
    return F.when(F.size(keywords) > 0, F.concat_ws(". ", F.concat_ws(", ", expanded), F.nullif(F.substring(strip(text), 1, SEMANTIC_CHARS), F.lit(""))))


def recent_context(rows: DataFrame, key: str, at: str, tie: str, line: Column, n: int = 5) -> DataFrame:
    """Each key's last ``n`` lines, oldest first, as one text."""
    w = Window.partitionBy(key).orderBy(F.col(at).desc(), F.col(tie).desc())
    kept = rows.withColumn("__line", line).withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n)
    return kept.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("__n")).alias("o"), "__line"))), lambda x: x["__line"]), "\n").alias("context"))


def first_known(*sides: tuple[DataFrame, str], key: str, ids: DataFrame) -> DataFrame:
    """For every id the value of the first side that has it; ``found`` is false where none does."""
    out = ids
    for k, (side, value) in enumerate(sides):
        out = out.join(side.select(key, F.col(value).alias(f"__{k}"), F.lit(True).alias(f"__has{k}")), key, "left")
    has = [F.coalesce(F.col(f"__has{k}"), F.lit(False)) for k in range(len(sides))]
    return out.select(*ids.columns, F.coalesce(*[F.when(h, F.col(f"__{k}")) for k, h in enumerate(has)]).alias("value"), F.greatest(*has).alias("found"))


def pending_best(rows: DataFrame, keys: list[str], at: str, score: str, gap: float, id_col: str) -> DataFrame:
    """The best row of every ``gap`` seconds; of equal scores the later one."""
    return rows.groupBy(*keys, F.floor(F.col(at) / gap).alias("slot")).agg(F.max_by(id_col, F.struct(score, at)).alias(id_col), F.max(score).alias(score))


def single_analysis(rows: DataFrame, group: str, analysis: str) -> DataFrame:
    """Rows of groups that hold at most one analysis; a mixed group is empty and reported as partial by its absence."""
    kinds = rows.groupBy(group).agg(F.countDistinct(analysis).alias("__kinds"))
    return rows.join(kinds.filter("__kinds <= 1").select(group), group, "left_semi")


def quality(rows: DataFrame, key: str) -> DataFrame:
    """Least visibility and mean coverage of the values that are numbers, and all limitations, sorted."""
    return rows.groupBy(key).agg(F.min(F.expr("try_cast(visibility AS double)")).alias("visibility"), F.avg(F.expr("try_cast(coverage AS double)")).alias("coverage"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("limitations")))).alias("limitations"))


def join_batches(batches: DataFrame, key: str) -> DataFrame:
    """Batches that did not fail as one reply: texts in order, frames and latency summed, ids made unique by batch."""
    good = batches.filter("not failed")
    parts = F.array_sort(F.collect_list(F.struct("batch_no", "text")))
    ids = F.array_sort(F.flatten(F.collect_list(F.transform("ids", lambda i: F.concat(F.lit("b"), F.col("batch_no").cast("string"), F.lit("_"), i)))))
    return good.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n").alias("text"), F.sum("n_frames").alias("n_frames"), F.sum("latency_ms").alias("latency_ms"), ids.alias("ids"))


def carrier_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = carrier_events(spark, sf_dir)
    odd = F.when(F.col("event_id") % 3 != 0, canonical_type(F.col("event_name")))
    ready = e.select(
        "event_id", "event_name", "at", "confidence", odd.alias("event_type"), (F.col("at") + F.col("event_id") % 7).alias("end_sec"), F.concat(F.lit("seen "), F.col("event_id").cast("string")).alias("description"),
        F.array(F.concat(F.lit("k"), (F.col("event_id") % 4).cast("string"))).alias("keywords"), F.array(F.concat(F.lit("ev"), F.col("event_id").cast("string"))).alias("evidence_ids"), (F.col("event_id") % 101).cast("int").alias("risk_hint"),
    )
    return number_sessions(ready, ["event_name"], "at", 1800.0, "event_id")


def q_temporal_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fold_sessions(carrier_numbered(spark, sf_dir), ["event_name"], "at", "event_id")
    return f.select("event_name", "session_no", F.round("end_sec", 3).alias("end_sec"), "occurrence_count", "description", F.coalesce("event_type", F.lit("-")).alias("event_type"), F.array_join("keywords", ",").alias("keywords"), F.array_join("evidence_ids", ",").alias("evidence_ids"), "risk_hint", F.round("duration", 3).alias("duration"))


def q_evidence_widening(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(
        "event_id", (seconds(F.col("ts"))).alias("start_sec"), (seconds(F.col("ts")) - 1).alias("end_sec"), F.array(*[F.concat(F.lit("ev"), (F.col("event_id") + d).cast("string")) for d in (0, 1, 7)]).alias("evidence_ids")
    )
    frames = table(spark, sf_dir, "events").select(F.concat(F.lit("ev"), F.col("event_id").cast("string")).alias("evidence_id"), seconds(F.col("ts")).alias("frame_sec"))
    return widen_by_evidence(events, frames, "event_id").select("event_id", F.round("start_sec", 3).alias("start_sec"), F.round("end_sec", 3).alias("end_sec"))


def q_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    rules = F.when(F.col("event_id") % 3 == 0, F.array(F.lit("R1"), F.lit("R2"))).otherwise(F.array().cast("array<string>"))
    text = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("  at "), clock(F.col("value") + 0.25), F.lit(" ")))
    return e.select("event_id", describe(F.col("event_type"), text, (F.col("event_id") % 4).cast("int"), rules).alias("text"))


def q_client_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    primary = e.filter("event_type = 'error'").select("user_id", "event_id", (F.round("value", 0) % 101).cast("int").alias("score"))
    fallback = e.filter("event_type = 'view'").select("user_id", "event_id", F.lit(0).alias("score"))
    rows = with_fallback(primary.filter("user_id % 3 != 0"), fallback, "user_id")
    return rows.select("user_id", "event_id", level_of(F.col("score").cast("double"), inclusive=True).alias("level"))


def q_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return labels.select("doc_id", guard(F.col("toxic") == 1, F.when(F.col("doc_id") % 11 != 0, (F.col("doc_id") % 10) / 10.0), F.col("doc_id") % 13 == 0).alias("action"))


def q_semantic_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    words = F.when(F.col("doc_id") % 4 == 0, F.array().cast("array<string>")).when(F.col("doc_id") % 4 == 1, F.array(F.lit("error"), F.lit("loose_cable"))).otherwise(F.array(F.lit("click")))
    return docs.select("doc_id", F.coalesce(F.md5(semantic_query(words, F.col("text"))), F.lit("-")).alias("query_md5"))


def q_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("at_sec", seconds(F.col("ts")))
    return recent_context(e, "user_id", "at_sec", "event_id", F.concat_ws(" ", F.col("event_id").cast("string"), "event_type"))


def q_acknowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    memory, stored = e.filter("event_id % 5 = 0").withColumn("event_type", F.lit("memory")), e.filter("event_id % 2 = 0")
    return first_known((memory, "event_type"), (stored, "event_type"), key="event_id", ids=e.select("event_id")).select("event_id", F.coalesce("value", F.lit("-")).alias("value"), "found")


def q_pending_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", seconds(F.col("ts")).alias("at_sec"), F.floor(F.col("value") / 50).alias("score"))
    return pending_best(e, ["user_id"], "at_sec", "score", 86400.0, "event_id").select("user_id", F.col("slot").cast("long").alias("slot"), "event_id", "score")


def q_single_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 997).alias("call_id"), F.when(F.col("event_id") % 997 < 500, F.lit("a")).otherwise(F.col("event_type")).alias("analysis_id"))
    return single_analysis(e, "call_id", "analysis_id").select("event_id", "call_id")


def q_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    rows = e.select("user_id", F.when(F.col("event_id") % 2 == 0, "clear").otherwise((F.col("event_id") % 9 / 8.0).cast("string")).alias("visibility"), F.when(F.col("event_id") % 3 == 0, (F.col("event_id") % 5 / 4.0).cast("string")).alias("coverage"), F.array("event_type").alias("limitations"))
    return quality(rows, "user_id").select("user_id", "visibility", F.round("coverage", 6).alias("coverage"), F.array_join("limitations", ",").alias("limitations"))


def q_join_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    rows = c.select("conv_id", F.col("turn").alias("batch_no"), F.col("role").alias("text"), (F.col("turn") % 4 == 3).alias("failed"), (F.col("turn") + 1).alias("n_frames"), (F.col("turn") * 2).alias("latency_ms"), F.array(F.concat(F.lit("e"), F.col("turn").cast("string"))).alias("ids"))
    return join_batches(rows, "conv_id").withColumn("ids", F.array_join("ids", ","))


QUERIES = {f.__name__: f for f in (q_temporal_fold, q_evidence_widening, q_descriptions, q_client_events, q_guard, q_semantic_query, q_context, q_acknowledge, q_pending_best, q_single_analysis, q_quality, q_join_batches)}
ORACLE_SQL = {
    "q_temporal_fold": f"""
WITH {SESSIONS_CTE},
r AS (SELECT *, CASE WHEN event_id % 3 <> 0 THEN CASE event_name WHEN 'error' THEN 'yangin_duman' WHEN 'purchase' THEN 'arac_yaya_yakinligi' WHEN 'click' THEN 'kkd_ihlali' WHEN 'signup' THEN 'dusme_riski' END END AS kind FROM numbered),
f AS (
  SELECT event_name, session_no, min(at_sec) AS start_sec, arg_max(at_sec + event_id % 7, at_sec) AS end_sec, count(*) AS occurrence_count, arg_max('seen ' || event_id, at_sec) AS description, coalesce(arg_max(kind, at_sec) FILTER (kind IS NOT NULL), '-') AS event_type,
    array_to_string(list_transform(list_sort(list_transform(list_distinct(list('k' || event_id % 4)), lambda x: {{'o': list_position(list('k' || event_id % 4 ORDER BY at_sec, event_id), x), 'x': x}})), lambda y: y.x), ',') AS keywords,
    string_agg('ev' || event_id, ',' ORDER BY at_sec, event_id) AS evidence_ids, CAST(max(event_id % 101) AS INTEGER) AS risk_hint FROM r GROUP BY event_name, session_no)
SELECT event_name, CAST(session_no AS BIGINT) AS session_no, round(end_sec, 3) AS end_sec, occurrence_count, description, event_type, keywords, evidence_ids, risk_hint, round(greatest(0, end_sec - start_sec), 3) AS duration FROM f""",
    "q_evidence_widening": """
WITH e AS (SELECT event_id, epoch(ts) AS s, unnest([event_id, event_id + 1, event_id + 7]) AS f FROM events), w AS (SELECT e.event_id, any_value(s) AS s, min(epoch(ts)) AS low, max(epoch(ts)) AS high FROM e LEFT JOIN events v ON v.event_id = e.f GROUP BY e.event_id)
SELECT event_id, round(least(s, low), 3) AS start_sec, round(greatest(s, high), 3) AS end_sec FROM w""",
    "q_descriptions": """
WITH d AS (SELECT *, CAST(round_even(value + 0.25, 0) AS BIGINT) AS w FROM events)
SELECT event_id, concat_ws(' ', CASE WHEN event_id % 2 = 0 THEN 'at ' || lpad(CAST(w // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(w % 60 AS VARCHAR), 2, '0') ELSE event_type END, CASE WHEN event_id % 4 > 1 THEN '(seen ' || event_id % 4 || ' times)' END, CASE WHEN event_id % 3 = 0 THEN '[R1 | R2]' END) AS text FROM d""",
    "q_client_events": """
WITH p AS (SELECT user_id, event_id, CAST(round(value, 0) % 101 AS INTEGER) AS score FROM events WHERE event_type = 'error' AND user_id % 3 <> 0),
u AS (SELECT * FROM p UNION ALL SELECT user_id, event_id, 0 FROM events WHERE event_type = 'view' AND user_id NOT IN (SELECT user_id FROM p))
SELECT user_id, event_id, CASE WHEN score <= 25 THEN 'dusuk' WHEN score <= 50 THEN 'orta' WHEN score <= 75 THEN 'yuksek' ELSE 'kritik' END AS level FROM u""",
    "q_guard": "SELECT doc_id, CASE WHEN doc_id % 13 = 0 OR doc_id % 11 = 0 OR toxic IS NULL THEN 'quarantine' WHEN toxic = 1 AND doc_id % 10 >= 8 THEN 'quarantine' ELSE 'allow' END AS action FROM labels",
    "q_semantic_query": r"""
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '-' ELSE md5(concat_ws('. ', CASE WHEN doc_id % 4 = 1 THEN 'fire and smoke, loose cable' ELSE 'personal protective equipment' END, nullif(substr(regexp_replace(text, '^\s+|\s+$', '', 'g'), 1, 200), ''))) END AS query_md5 FROM documents""",
    "q_context": "SELECT user_id, string_agg(event_id || ' ' || event_type, chr(10) ORDER BY n DESC) AS context FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 5 GROUP BY user_id",
    "q_acknowledge": "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'memory' WHEN event_id % 2 = 0 THEN event_type ELSE '-' END AS value, event_id % 5 = 0 OR event_id % 2 = 0 AS found FROM events",
    "q_pending_best": "SELECT user_id, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS slot, arg_max(event_id, {'s': floor(value / 50), 't': ts}) AS event_id, CAST(max(floor(value / 50)) AS BIGINT) AS score FROM events GROUP BY ALL",
    "q_single_analysis": "SELECT event_id, event_id % 997 AS call_id FROM events WHERE event_id % 997 < 500 OR event_id % 997 IN (SELECT event_id % 997 FROM events GROUP BY 1 HAVING count(DISTINCT event_type) <= 1)",
    "q_quality": """
SELECT user_id, min(CASE WHEN event_id % 2 <> 0 THEN event_id % 9 / 8 END) AS visibility, round(avg(CASE WHEN event_id % 3 = 0 THEN event_id % 5 / 4 END), 6) AS coverage, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS limitations FROM events GROUP BY user_id""",
    "q_join_batches": """
WITH g AS (SELECT * FROM conversations WHERE turn % 4 <> 3)
SELECT conv_id, string_agg(role, chr(10) || chr(10) ORDER BY turn, role) AS text, CAST(sum(turn + 1) AS BIGINT) AS n_frames, CAST(sum(turn * 2) AS BIGINT) AS latency_ms, string_agg('b' || turn || '_e' || turn, ',' ORDER BY 'b' || turn || '_e' || turn) AS ids FROM g GROUP BY conv_id""",
}
