"""Detection in text, lenient parsing of model output, time normalisation and segment plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.functions.text import strip
from rillflow.functions.values import DETECTION_WORDS, EVENT_TYPES, NEGATION_CUES, NEGATION_WINDOW
from rillflow.operators.sessions import seconds
from rillflow.session import table

BASE_CONFIDENCE = 0.5
CONFIDENCE_STEP = 0.1
GENERAL = "genel_gozlem"
TOLERANCE_SEC = 2.0
MOST_SEGMENTS = 100_000
STATUSES = ("success", "success_empty", "partial", "model_failed", "parse_failed", "quality_insufficient")


def clauses(text: Column) -> Column:
    """Trimmed parts of the lower-cased text between clause marks, without empty ones."""
    return F.filter(F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[.!?;]+"), strip), lambda c: c != "")


def split_words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def negated(clause: Column, keyword: str, window: int = NEGATION_WINDOW) -> Column:
    """Whether a cue occurs within ``window`` words before or after the keyword's first place in the clause."""
    before = F.size(split_words(F.substring_index(clause, keyword, 1)))
    words = split_words(clause)
    low = F.greatest(F.lit(0), before - window)
    high = F.least(F.size(words), before + len(keyword.split()) + window)
    around = F.array_join(F.slice(words, low + 1, F.greatest(F.lit(0), high - low)), " ")
    return F.exists(F.array(*map(F.lit, NEGATION_CUES)), lambda cue: F.contains(around, cue))


def found_keywords(parts: Column, keywords: tuple[str, ...], lowered: Column | None = None) -> Column:
    """Keywords that occur in one of the clauses; only the first clause that contains a keyword decides whether it is negated.

    With the lower-cased text the clauses are only looked at where it contains the keyword.
    """

    def check(keyword: str) -> Column:
        first = F.slice(F.filter(parts, lambda c: F.contains(c, F.lit(keyword))), 1, 1)
        hit = F.transform(F.filter(first, lambda c: ~negated(c, keyword)), lambda _: F.lit(keyword))
        return hit if lowered is None else F.when(F.contains(lowered, F.lit(keyword)), hit).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.array(*[check(k) for k in keywords]))


def detect(rows: DataFrame, text: str, dictionary: dict[str, tuple[str, ...]] = DETECTION_WORDS) -> DataFrame:
    """One row per event type found, or one general row with confidence 0: event_type, matched, confidence.

    Confidence is 0.5 and 0.1 more for each further keyword, at most 1.
    """
    per_type = [F.struct(F.lit(name).alias("event_type"), found_keywords(F.col("__parts"), words, F.col("__low")).alias("matched")) for name, words in dictionary.items()]
    hits = F.col("__hits")
    none = F.array(F.struct(F.lit(GENERAL).alias("event_type"), F.array().cast("array<string>").alias("matched")))
    cut = rows.withColumn("__parts", clauses(F.col(text))).withColumn("__low", F.lower(F.coalesce(F.col(text), F.lit(""))))
    cut = cut.withColumn("__hits", F.filter(F.array(*per_type), lambda x: F.size(x["matched"]) > 0))
    spread = cut.withColumn("__hit", F.explode(F.when(F.size(hits) > 0, hits).otherwise(none))).select(*rows.columns, "__hit.event_type", "__hit.matched")
    return spread.withColumn("confidence", F.when(F.col("event_type") == GENERAL, 0.0).otherwise(F.least(F.lit(1.0), BASE_CONFIDENCE + CONFIDENCE_STEP * (F.size("matched") - 1))))


def repaired_json(raw: Column) -> Column:
    """The event array after ``EVENTS_JSON:`` (or the text itself), without trailing commas."""
    tail = F.regexp_extract(raw, r"(?is)EVENTS_JSON:\s*(\[.*\])", 1)
    return F.regexp_replace(F.when(tail != "", tail).otherwise(raw), r",\s*([\]}])", "$1")


def parse_events(rows: DataFrame, raw: str, least_confidence: float = 0.0) -> DataFrame:
    """One row per event object of the model's output: event_name, event_type, confidence, risk_hint.

    Names come under any of four keys; unknown types become null; confidences
    are held within 0 to 1 with 0.5 where missing; hints are rounded and held
    within 0 to 100.  Output that does not parse is tried again with its single
    quotes made double ones; what still does not parse gives no rows.
    """
    item, repaired = F.expr("try_variant_get(value, '$', 'map<string,variant>')"), repaired_json(F.col(raw))
    parsed = rows.withColumn("__v", F.coalesce(F.try_parse_json(repaired), F.try_parse_json(F.replace(repaired, F.lit("'"), F.lit('"')))))
    items = parsed.withColumn("__items", F.expr("try_variant_get(__v, '$', 'array<variant>')")).select(*rows.columns, F.posexplode("__items").alias("pos", "value")).filter(item.isNotNull())
    get = lambda key, kind: F.expr(f"try_variant_get(value, '$.{key}', '{kind}')")
    text = lambda key: F.nullif(strip(get(key, "string")), F.lit(""))
    name = F.coalesce(text("event_name"), text("event"), text("event_label"), text("type"))
    kind = F.when(text("event_type").isin(*EVENT_TYPES), text("event_type"))
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(get("confidence", "double"), F.lit(0.5))))
    hint = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.bround(get("risk_hint", "double"), 0)))
    return (
        items.select(*rows.columns, "pos", name.alias("event_name"), kind.alias("event_type"), F.bround(confidence, 2).alias("confidence"), F.when(get("risk_hint", "double").isNotNull(), hint).cast("int").alias("risk_hint"))
        .filter(F.col("event_name").isNotNull() & (F.col("confidence") >= least_confidence))
    )


def normalize_times(rows: DataFrame, start: str, end: str, offset: str, duration: str, tolerance: float = TOLERANCE_SEC) -> DataFrame:
    """Add time_status, global_start, global_end and reasons for times relative to a chunk.

    Missing times, a missing start, NaN or infinity, start after end, and times
    beyond the tolerance are not used; within the tolerance they are clamped.
    """
    s, e, d = F.col(start), F.coalesce(F.col(end), F.col(start)), F.col(duration)
    odd = lambda x: F.isnan(x) | (F.abs(x) == float("inf"))
    status = (
        F.when(F.col(start).isNull() & F.col(end).isNull(), "missing").when(F.col(start).isNull(), "invalid").when(odd(s) | odd(e), "invalid").when(s > e, "invalid")
        .when(s < -tolerance, "invalid").when(d.isNotNull() & (e > d + tolerance), "invalid").otherwise("valid")
    )
    reasons = F.array_compact(F.array(F.when(F.col(end).isNull(), "point"), F.when(s < 0, "start clamped"), F.when(d.isNotNull() & (e > d), "end clamped")))
    valid = F.col("time_status") == "valid"
    return (
        rows.withColumn("time_status", status)
        .withColumn("global_start", F.when(valid, F.col(offset) + F.greatest(F.lit(0.0), s)))
        .withColumn("global_end", F.when(valid, F.col(offset) + F.when(d.isNotNull(), F.least(e, d)).otherwise(e)))
        .withColumn("reasons", F.when(valid, reasons).otherwise(F.array().cast("array<string>")))
    )


def segment_plan(videos: DataFrame, duration: str, window: float, overlap: float) -> DataFrame:
    """Overlapping segments of every video: index, start_sec, end_sec, overlap_left_sec, overlap_right_sec.

    Segments start every ``window - overlap`` seconds until one reaches the end;
    more than ``MOST_SEGMENTS`` of them in one video is an error.
    """
    if not (window > 0 and 0 <= overlap < window):
        raise ValueError("window must be positive and overlap in [0, window)")
    step = window - overlap
    last = F.greatest(F.lit(0), F.ceil((F.col(duration) - window) / step)).cast("int")
    checked = F.when(last >= MOST_SEGMENTS, F.raise_error(F.lit("too many segments")).cast("int")).otherwise(last)
    start, end = F.col("index") * step, F.least(F.col("index") * step + window, F.col(duration))
    return (
        videos.filter(F.col(duration) > 0).withColumn("__last", checked).withColumn("index", F.explode(F.sequence(F.lit(0), "__last")))
        .withColumn("start_sec", start).withColumn("end_sec", end)
        .withColumn("overlap_left_sec", F.when(F.col("index") > 0, overlap).otherwise(0.0))
        .withColumn("overlap_right_sec", F.when(F.col("index") < F.col("__last"), overlap).otherwise(0.0))
        .drop("__last")
    )


def chunk_status(results: DataFrame, key: str, status: str) -> DataFrame:
    """One status for every analysis from its chunks' statuses, by the decision tree, with the counts it rests on."""
    n = lambda *names: F.count_if(F.col(status).isin(*names))
    counts = results.groupBy(key).agg(
        F.count("*").alias("n"), n("success").alias("n_success"), n("success_empty").alias("n_empty"), n("partial").alias("n_partial"),
        n("model_failed", "parse_failed").alias("n_failed"), n("parse_failed").alias("n_parse"), n("quality_insufficient").alias("n_quality"),
    )
    c = F.col
    tree = (
        F.when(c("n_success") == c("n"), "success").when(c("n_empty") == c("n"), "success_empty").when(c("n_empty") + c("n_success") == c("n"), "success")
        .when(c("n_quality") == c("n"), "quality_insufficient").when(c("n_parse") == c("n"), "parse_failed").when(c("n_failed") == c("n"), "model_failed")
        .when(c("n_success") + c("n_partial") + c("n_empty") > 0, "partial").otherwise("model_failed")
    )
    return counts.withColumn("analysis_status", tree)


def normalized_source(source: Column, data_dir: str = "data/videos") -> Column:
    """Addresses and absolute paths as they are; anything else is its base name in the data folder."""
    base = F.regexp_extract(source, r"([^/\\]+)$", 1)
    return F.when(source.rlike("^(rtsp|rtsps|https?)://") | source.startswith("/"), source).otherwise(F.concat(F.lit(data_dir + "/"), base))


def fixed_batches(numbered: DataFrame, key: str, size: int) -> DataFrame:
    """Batches of ``size`` rows from a zero-based ordinal, without a sort."""
    return numbered.withColumn("batch_no", F.floor(F.col(key) / size))


CARRIER_WORDS = {"fire": ("license", "secret", "token"), "gate": ("work is", "under the"), "load": ("the ", "le ", "der ")}


def q_keyword_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detection with words of the carrier's languages, and the built-in negation cues."""
    found = detect(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", CARRIER_WORDS)
    return found.select("doc_id", "event_type", F.array_join("matched", "|").alias("matched"), F.round("confidence", 2).alias("confidence"))


def q_json_events_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    named = F.when(F.col("event_id") % 3 == 0, F.lit("event_name")).when(F.col("event_id") % 3 == 1, F.lit("event")).otherwise(F.lit("type"))
    raw = F.format_string('text EVENTS_JSON: [{"%s": " %s ", "event_type": "%s", "confidence": %s, "risk_hint": %d},]', named, F.col("event_type"), F.when(F.col("event_id") % 2 == 0, "yangin_duman").otherwise("other"), (F.col("event_id") % 13 / 8.0).cast("string"), (F.col("event_id") % 120).cast("int"))
    return parse_events(e.select("event_id", raw.alias("raw")), "raw").select("event_id", "pos", "event_name", "event_type", "confidence", "risk_hint")


def q_json_quote_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    raw = F.when(F.col("event_id") % 3 == 0, F.format_string("EVENTS_JSON: [{'event': '%s', 'confidence': 0.25,},]", "event_type")).when(F.col("event_id") % 3 == 1, F.format_string("[{'event': 'it's %s'}]", "event_type")).otherwise(F.format_string('[{"event": "it\'s %s"}, 5]', "event_type"))
    return parse_events(e.select("event_id", raw.alias("raw")), "raw").select("event_id", "pos", "event_name", "confidence")


def q_time_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    rows = e.select(
        "event_id", F.when(F.col("event_id") % 17 != 0, F.col("event_id") % 40 / 2.0 - 3).alias("start"), F.when(F.col("event_id") % 5 != 0, F.col("event_id") % 53 / 2.0 - 3).alias("end"),
        (F.col("event_id") % 9 * 20.0).alias("offset"), F.lit(20.0).alias("duration"),
    )
    out = normalize_times(rows, "start", "end", "offset", "duration")
    return out.select("event_id", "time_status", F.coalesce("global_start", F.lit(-1.0)).alias("global_start"), F.coalesce("global_end", F.lit(-1.0)).alias("global_end"), F.array_join("reasons", "|").alias("reasons"))


def q_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = seconds(F.col("ts"))
    spans = table(spark, sf_dir, "events").groupBy("user_id").agg((F.max(at) - F.min(at)).alias("duration"))
    out = segment_plan(spans, "duration", 86400.0, 7200.0)
    return out.select("user_id", "index", "start_sec", F.round("end_sec", 3).alias("end_sec"), "overlap_left_sec", "overlap_right_sec")


def q_chunk_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    pick = F.when(F.col("user_id") % 4 == 0, 0).when(F.col("user_id") % 4 == 1, F.col("event_id") % 2).when(F.col("user_id") % 4 == 2, F.col("event_id") % 6).otherwise(F.col("event_id") % 2 + 3)
    return chunk_status(e.select("user_id", F.element_at(F.array(*map(F.lit, STATUSES)), (pick + 1).cast("int")).alias("status")), "user_id", "status")


def q_source_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    given = F.when(F.col("page_id") % 3 == 0, F.col("url")).when(F.col("page_id") % 3 == 1, F.concat(F.lit("/abs/"), F.col("page_id").cast("string"))).otherwise(F.concat(F.lit("a/b\\c"), F.col("page_id").cast("string"), F.lit(".mp4")))
    return pages.select("page_id", normalized_source(given).alias("source"))


def q_fixed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixed_batches(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", 64).groupBy("batch_no").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))


def _detect_sql() -> str:
    cues = "[" + ", ".join(f"'{c}'" for c in NEGATION_CUES) + "]"
    checks = []
    for name, words in CARRIER_WORDS.items():
        for w in words:
            n = len(w.split())
            checks.append(
                f"SELECT doc_id, '{name}' AS event_type, '{w}' AS keyword, {len(checks)} AS ord FROM (SELECT doc_id, list_filter(parts, lambda c: contains(c, '{w}'))[1] AS c FROM p WHERE len(list_filter(parts, lambda c: contains(c, '{w}'))) > 0) "
                f"WHERE NOT list_bool_or(list_transform({cues}, lambda q: contains(array_to_string(list_filter(regexp_split_to_array(c, '\\s+'), lambda x: x <> '')[greatest(0, len(list_filter(regexp_split_to_array(split_part(c, '{w}', 1), '\\s+'), lambda x: x <> '')) - 5) + 1 : "
                f"len(list_filter(regexp_split_to_array(split_part(c, '{w}', 1), '\\s+'), lambda x: x <> '')) + {n} + 5], ' '), q)))"
            )
    return (
        "WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(lower(text), '[.!?;]+'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS parts FROM documents),\n"
        "h AS (" + "\nUNION ALL ".join(checks) + "),\n"
        "g AS (SELECT doc_id, event_type, string_agg(keyword, '|' ORDER BY ord) AS matched, count(*) AS n FROM h GROUP BY doc_id, event_type)\n"
        "SELECT doc_id, event_type, matched, round(least(1.0, 0.5 + CAST(0.1 AS DOUBLE) * (n - 1)), 2) AS confidence FROM g\n"
        "UNION ALL SELECT doc_id, 'genel_gozlem', '', 0.0 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM g)"
    )


QUERIES = {f.__name__: f for f in (q_keyword_detect, q_json_events_parse, q_json_quote_repair, q_time_normalize, q_segments, q_chunk_status, q_source_names, q_fixed_batches)}
ORACLE_SQL = {
    "q_keyword_detect": _detect_sql(),
    "q_json_events_parse": """
SELECT event_id, 0 AS pos, event_type AS event_name, CASE WHEN event_id % 2 = 0 THEN 'yangin_duman' END AS event_type,
  round_even(least(1.0, event_id % 13 / 8), 2) AS confidence, CAST(least(100, event_id % 120) AS INTEGER) AS risk_hint FROM events""",
    "q_json_quote_repair": "SELECT event_id, 0 AS pos, CASE WHEN event_id % 3 = 2 THEN 'it''s ' ELSE '' END || event_type AS event_name, CAST(CASE WHEN event_id % 3 = 0 THEN 0.25 ELSE 0.5 END AS DOUBLE) AS confidence FROM events WHERE event_id % 3 <> 1",
    "q_time_normalize": """
WITH r AS (SELECT event_id, CASE WHEN event_id % 17 <> 0 THEN event_id % 40 / 2 - 3 END AS s, CASE WHEN event_id % 5 <> 0 THEN event_id % 53 / 2 - 3 END AS e0, event_id % 9 * 20.0 AS o, 20.0 AS d FROM events),
x AS (SELECT *, coalesce(e0, s) AS e FROM r),
y AS (SELECT *, CASE WHEN s IS NULL AND e0 IS NULL THEN 'missing' WHEN s IS NULL OR s > e OR s < -2 OR e > d + 2 THEN 'invalid' ELSE 'valid' END AS time_status FROM x)
SELECT event_id, time_status, CAST(CASE WHEN time_status = 'valid' THEN o + greatest(0, s) ELSE -1 END AS DOUBLE) AS global_start, CAST(CASE WHEN time_status = 'valid' THEN o + least(e, d) ELSE -1 END AS DOUBLE) AS global_end,
  CASE WHEN time_status = 'valid' THEN concat_ws('|', CASE WHEN e0 IS NULL THEN 'point' END, CASE WHEN s < 0 THEN 'start clamped' END, CASE WHEN e > d THEN 'end clamped' END) ELSE '' END AS reasons FROM y""",
    "q_segments": """
WITH s AS (SELECT user_id, max(epoch(ts)) - min(epoch(ts)) AS duration FROM events GROUP BY user_id),
n AS (SELECT *, CAST(greatest(0, ceil((duration - 86400) / 79200)) AS INTEGER) AS last FROM s WHERE duration > 0),
i AS (SELECT *, CAST(unnest(generate_series(0, last)) AS INTEGER) AS index FROM n)
SELECT user_id, index, index * CAST(79200 AS DOUBLE) AS start_sec, round(least(index * CAST(79200 AS DOUBLE) + 86400, duration), 3) AS end_sec, CAST(CASE WHEN index > 0 THEN 7200 ELSE 0 END AS DOUBLE) AS overlap_left_sec, CAST(CASE WHEN index < last THEN 7200 ELSE 0 END AS DOUBLE) AS overlap_right_sec FROM i""",
    "q_chunk_status": """
WITH r AS (SELECT user_id, ['success', 'success_empty', 'partial', 'model_failed', 'parse_failed', 'quality_insufficient'][CASE user_id % 4 WHEN 0 THEN 0 WHEN 1 THEN event_id % 2 WHEN 2 THEN event_id % 6 ELSE event_id % 2 + 3 END + 1] AS status FROM events),
c AS (SELECT user_id, count(*) AS n, count(*) FILTER (status = 'success') AS n_success, count(*) FILTER (status = 'success_empty') AS n_empty, count(*) FILTER (status = 'partial') AS n_partial,
  count(*) FILTER (status IN ('model_failed', 'parse_failed')) AS n_failed, count(*) FILTER (status = 'parse_failed') AS n_parse, count(*) FILTER (status = 'quality_insufficient') AS n_quality FROM r GROUP BY user_id)
SELECT *, CASE WHEN n_success = n THEN 'success' WHEN n_empty = n THEN 'success_empty' WHEN n_empty + n_success = n THEN 'success' WHEN n_quality = n THEN 'quality_insufficient' WHEN n_parse = n THEN 'parse_failed' WHEN n_failed = n THEN 'model_failed'
  WHEN n_success + n_partial + n_empty > 0 THEN 'partial' ELSE 'model_failed' END AS analysis_status FROM c""",
    "q_source_names": r"""
SELECT page_id, CASE WHEN page_id % 3 = 0 AND regexp_matches(url, '^(rtsp|rtsps|https?)://') THEN url WHEN page_id % 3 = 0 THEN 'data/videos/' || regexp_extract(url, '([^/\\]+)$', 1) WHEN page_id % 3 = 1 THEN '/abs/' || page_id ELSE 'data/videos/c' || page_id || '.mp4' END AS source FROM pages""",
    "q_fixed_batches": "SELECT doc_id // 64 AS batch_no, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents GROUP BY batch_no",
}
