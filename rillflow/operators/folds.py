"""Operators whose result depends on processing order: interval merging, greedy batches, splitting of long texts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.functions.text import estimated_tokens, estimated_tokens_py
from rillflow.operators.chains import chain_starts, with_starts
from rillflow.operators.ranges import running
from rillflow.operators.selection import SelectionParams, select_frames
from rillflow.operators.series import carrier_series
from rillflow.plans.lineage import materialize
from rillflow.session import table

MIN_IOU, MAX_BOUNDARY_GAP_SEC, MIN_LABEL_SIMILARITY = 0.3, 5.0, 0.5
#: The carrier's messages are short: its longest estimate is below this budget.
BATCH_TOKENS = 1_000
#: Where a text that is too long is cut: paragraphs first, then lines, sentences, clauses, words.
SEPARATORS = ("\n\n", "\n", ". ", "; ", ", ", " ")


def names_alike(a: str, b: str) -> float:
    """Jaccard similarity of the words of two names; 0 without words."""
    x, y = set(a.lower().split()), set(b.lower().split())
    return len(x & y) / len(x | y) if x | y else 0.0


def may_merge(a: dict, b: dict, min_iou: float, max_gap: float, min_similarity: float) -> bool:
    """Whether two intervals of one video are the same occurrence: never from one chunk, of one type, with similar names, overlapping enough or close."""
    if set(a["chunk_ids"]) & set(b["chunk_ids"]) or a["event_type"] != b["event_type"]:
        return False
    overlap = min(a["end_sec"], b["end_sec"]) - max(a["start_sec"], b["start_sec"])
    if overlap > 0:
        together = max(a["end_sec"], b["end_sec"]) - min(a["start_sec"], b["start_sec"])
        if overlap / together < min_iou:
            return False
    elif -overlap > max_gap:
        return False
    return names_alike(a["event_name"], b["event_name"]) >= min_similarity


def merge_intervals(events: DataFrame, keys: list[str], min_iou: float = MIN_IOU, max_gap: float = MAX_BOUNDARY_GAP_SEC, min_similarity: float = MIN_LABEL_SIMILARITY) -> DataFrame:
    """First-fit merge of (event_id, event_name, event_type, start_sec, end_sec, confidence, occurrence_count, chunk_ids, observation_ids) by analysis and video.

    Events are taken in order of their start (id for ties); each joins the first
    merged event it fits, else opens one.  The first event's name and type stay;
    confidence and count are the highest; lists unite in order; a merged event's
    id is made from its sorted observation ids.

    First fit depends on the events before, but never across types nor across a
    gap that no earlier event of the type reaches; so each analysis, video, type
    and stretch between such gaps is a group of its own, cut by a running maximum
    that goes from range to range.  A task reads its groups in order, row by row, and holds only merged
    events that still reach the present one.  A row without a start or an end stays as it is.
    """
    schema = events.schema
    names = [f.name for f in schema]
    order = [F.col("start_sec").asc(), F.col("event_id").asc()]
    reached = running(events, [*keys, "event_type"], order, {"__reached": (F.col("end_sec"), F.max)}, own=False)
    opened = F.coalesce(F.col("start_sec") > F.col("__reached") + max_gap, F.lit(False)).cast("long")
    islands = running(reached, [*keys, "event_type"], order, {"__island": (opened, F.sum)})

    group = [*keys, "event_type", "__island"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple | None = None
        active: list[dict] = []
        for batch in batches:
            done: list[dict] = []
            for row in batch.to_pylist():
                own = tuple(row[k] for k in group)
                if own != at:
                    done += active
                    at, active = own, []
                if row["start_sec"] is None or row["end_sec"] is None:
                    done.append(row)
                    continue
                done += [m for m in active if m["end_sec"] < row["start_sec"] - max_gap]
                active = [m for m in active if m["end_sec"] >= row["start_sec"] - max_gap]
                home = next((m for m in active if may_merge(row, m, min_iou, max_gap, min_similarity)), None)
                if home is None:
                    active.append(row)
                    continue
                for name in ("chunk_ids", "observation_ids"):
                    home[name] = list(dict.fromkeys(home[name] + row[name]))
                home["end_sec"] = max(home["end_sec"], row["end_sec"])
                home["confidence"], home["occurrence_count"] = max(home["confidence"], row["confidence"]), max(home["occurrence_count"], row["occurrence_count"])
                home["event_id"] = "merged_" + hashlib.sha256("-".join(sorted(set(home["observation_ids"]))).encode()).hexdigest()[:8]
            kinds = pa.schema([batch.schema.field(n) for n in names])
            yield pa.RecordBatch.from_pylist([{n: m[n] for n in names} for m in done], schema=kinds)
        if active:
            yield pa.RecordBatch.from_pylist([{n: m[n] for n in names} for m in active], schema=kinds)

    dealt = islands.select(*names, "__island").repartition(*group).sortWithinPartitions(*group, *order)
    return dealt.mapInArrow(fold, schema)


def greedy_batches(rows: DataFrame, key: str, order: str, tokens: str, budget: int) -> DataFrame:
    """Add ``batch_no`` per key: consecutive rows fill a batch up to ``budget`` tokens; a row above the budget is an error.

    Prefix sums tell for every row where a batch that begins there would end, as the
    first row beyond the budget, found by sorting sums and limits together.  These
    pointers are doubled until they leave the key, and the batches' first rows are
    what the first row reaches; so the rounds grow with the logarithm of a key's
    batches and no task needs a whole key.  Null tokens count as 0, null keys as a key.
    """
    checked = rows.withColumn(tokens, F.when(F.col(tokens) > budget, F.raise_error(F.lit("a row exceeds the token budget")).cast("long")).otherwise(F.col(tokens)))
    counted = F.coalesce(F.col(tokens), F.lit(0)).cast("long")
    placed = materialize(running(checked, [key], [F.col(order).asc()], {"__at": (F.lit(1).cast("long"), F.sum), "__upto": (counted, F.sum)}), "placed")
    starts = chain_starts(placed, key, "__at", F.col("__upto"), F.col("__upto") - counted + budget)
    opened = with_starts(placed, starts, key, "__at", "__batch")
    return running(opened, [key], [F.col("__at").asc()], {"batch_no": (F.col("__batch"), F.max)}).select(*rows.columns, "batch_no")


def split_text(text: str, budget: int) -> list[str]:
    """Parts of at most ``budget`` estimated tokens, cut at the coarsest separator that helps; joined they are the text."""

    def cut(piece: str, level: int) -> Iterator[str]:
        if estimated_tokens_py(piece) <= budget:
            yield piece
        elif level == len(SEPARATORS):
            width = budget * 3
            yield from (piece[i : i + width] for i in range(0, len(piece), width))
        else:
            separator = SEPARATORS[level]
            parts = piece.split(separator)
            for k, part in enumerate(parts):
                whole = part + separator if k < len(parts) - 1 else part
                if whole:
                    yield from cut(whole, level + 1)

    out: list[str] = []
    used = 0
    for piece in cut(text, 0):
        n = estimated_tokens_py(piece)
        if out and used + n <= budget:
            out[-1] += piece
            used += n
        else:
            out.append(piece)
            used = n
    return out


def split_oversized(docs: DataFrame, id_col: str, text: str, budget: int) -> DataFrame:
    """(id, part_no, content): texts above the token budget in parts, others as they are; empty texts have no part."""

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, k, piece) for i, t in zip(batch[id_col], batch[text], strict=True) for k, piece in enumerate(split_text(t or "", budget))]
            yield pd.DataFrame(rows, columns=[id_col, "part_no", "content"])

    return docs.select(id_col, text).mapInPandas(parts, f"{id_col} long, part_no int, content string")


def q_interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = carrier_series(spark, sf_dir)
    events = s.select(
        F.col("user_id"), F.col("event_id").cast("string").alias("event_id"), F.concat_ws(" ", F.lit("seen"), "event_type").alias("event_name"), F.col("event_type"), F.col("at_sec").alias("start_sec"),
        (F.col("at_sec") + F.col("value") * 60).alias("end_sec"), F.least(F.lit(1.0), F.col("value") / 100).alias("confidence"), F.lit(1).alias("occurrence_count"),
        F.array(F.concat(F.lit("c"), F.floor(F.col("at_sec") / 3600).cast("string"))).alias("chunk_ids"), F.array(F.col("event_id").cast("string")).alias("observation_ids"),
    )
    merged = merge_intervals(events, ["user_id"], min_iou=0.1)
    return merged.select("user_id", "event_id", "event_type", F.round("start_sec", 3).alias("start_sec"), F.round("end_sec", 3).alias("end_sec"), F.size("observation_ids").alias("n_observations"))


def q_token_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", estimated_tokens(F.col("text")).alias("tokens"))
    return greedy_batches(rows, "conv_id", "turn", "tokens", BATCH_TOKENS)


def q_split_oversized(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = split_oversized(table(spark, sf_dir, "documents"), "doc_id", "text", 500)
    return parts.select("doc_id", "part_no", F.length("content").alias("n_chars"), F.md5("content").alias("content_md5"))


def q_frame_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = carrier_series(spark, sf_dir).select("user_id", "event_id", "at_sec", (F.col("value") / 50000).alias("ratio"), (F.col("event_id") % 10 / 10.0).alias("area"), (F.col("value") / 10000).alias("signature"))
    return select_frames(frames, "user_id", "event_id", "at_sec", "ratio", "area", "signature", SelectionParams(max_gap_sec=86400.0, early_interval_sec=7200.0, strong_interval_sec=3600.0, early_cooldown_sec=14400.0, strong_cooldown_sec=14400.0, fast_interval_sec=3600.0, slow_interval_sec=21600.0))


QUERIES = {f.__name__: f for f in (q_interval_merge, q_token_batches, q_split_oversized, q_frame_selection)}
ORACLE_SQL = {
    "q_interval_merge": """
WITH RECURSIVE e AS (
  SELECT user_id, event_type, event_id::VARCHAR AS id, epoch(ts) AS s, epoch(ts) + value * 60 AS t, 'c' || CAST(floor(epoch(ts) / 3600) AS BIGINT) AS chunk, row_number() OVER (PARTITION BY user_id, event_type ORDER BY epoch(ts), event_id::VARCHAR) AS k FROM events),
f AS (
  SELECT user_id, event_type, 1::BIGINT AS k, [{'s': s, 't': t, 'chunks': [chunk], 'ids': [id]}] AS merged FROM e WHERE k = 1
  UNION ALL
  SELECT user_id, event_type, k, CASE WHEN home = 0 THEN list_append(merged, {'s': s, 't': t, 'chunks': [chunk], 'ids': [id]})
    ELSE list_transform(merged, lambda m, i: CASE WHEN i = home THEN {'s': least(m.s, s), 't': greatest(m.t, t), 'chunks': list_append(m.chunks, chunk), 'ids': list_append(m.ids, id)} ELSE m END) END
  FROM (
    SELECT e.*, f.merged, coalesce(list_position(list_transform(f.merged, lambda m: NOT list_contains(m.chunks, e.chunk) AND
      CASE WHEN least(e.t, m.t) - greatest(e.s, m.s) > 0 THEN (least(e.t, m.t) - greatest(e.s, m.s)) / (greatest(e.t, m.t) - least(e.s, m.s)) >= 0.1 ELSE greatest(e.s, m.s) - least(e.t, m.t) <= 5 END), true), 0) AS home
    FROM f JOIN e ON e.user_id = f.user_id AND e.event_type = f.event_type AND e.k = f.k + 1)),
z AS (SELECT user_id, event_type, unnest(merged) AS m FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY k DESC) AS n FROM f) WHERE n = 1)
SELECT user_id, CASE WHEN len(m.ids) > 1 THEN 'merged_' || sha256(array_to_string(list_sort(m.ids), '-'))[1:8] ELSE m.ids[1] END AS event_id, event_type, round(m.s, 3) AS start_sec, round(m.t, 3) AS end_sec, CAST(len(m.ids) AS INTEGER) AS n_observations FROM z""",
    "q_split_oversized": r"""
WITH RECURSIVE p AS (
  SELECT doc_id, 0 AS level, CAST([] AS BIGINT[]) AS place, coalesce(text, '') AS piece FROM documents
  UNION ALL
  SELECT doc_id, level + 1, list_append(place, k), CASE WHEN k < len(parts) THEN parts[k] || sep ELSE parts[k] END
  FROM (SELECT *, unnest(generate_series(1, len(parts))) AS k FROM (SELECT *, string_split(piece, sep) AS parts FROM (SELECT *, [chr(10) || chr(10), chr(10), '. ', '; ', ', ', ' '][level + 1] AS sep FROM p WHERE level < 6 AND ceil(length(piece) / 3) > 500)))
),
w AS (
  SELECT doc_id, place, piece FROM p WHERE ceil(length(piece) / 3) <= 500 AND piece <> ''
  UNION ALL
  SELECT doc_id, list_append(place, k), piece[k * 1500 + 1:(k + 1) * 1500] FROM (SELECT *, unnest(generate_series(0, (length(piece) - 1) // 1500)) AS k FROM p WHERE level = 6 AND ceil(length(piece) / 3) > 500)),
n AS (SELECT doc_id, piece, CAST(ceil(length(piece) / 3) AS BIGINT) AS tokens, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS k FROM w),
f AS (
  SELECT doc_id, k, 0 AS part_no, tokens AS used, piece FROM n WHERE k = 1
  UNION ALL
  SELECT n.doc_id, n.k, CASE WHEN f.used + n.tokens <= 500 THEN f.part_no ELSE f.part_no + 1 END, CASE WHEN f.used + n.tokens <= 500 THEN f.used + n.tokens ELSE n.tokens END, n.piece FROM f JOIN n ON n.doc_id = f.doc_id AND n.k = f.k + 1),
o AS (SELECT doc_id, part_no, string_agg(piece, '' ORDER BY k) AS content FROM f GROUP BY doc_id, part_no)
SELECT doc_id, part_no, CAST(length(content) AS INTEGER) AS n_chars, md5(content) AS content_md5 FROM o""",
    "q_token_batches": """
WITH RECURSIVE r AS (SELECT conv_id, turn, CAST(ceil(length(coalesce(text, '')) / 3) AS BIGINT) AS tokens, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
f AS (
  SELECT conv_id, turn, tokens, k, 0 AS batch_no, tokens AS used FROM r WHERE k = 1
  UNION ALL
  SELECT r.conv_id, r.turn, r.tokens, r.k, CASE WHEN f.used > 0 AND f.used + r.tokens > 1000 THEN f.batch_no + 1 ELSE f.batch_no END, CASE WHEN f.used > 0 AND f.used + r.tokens > 1000 THEN r.tokens ELSE f.used + r.tokens END
  FROM f JOIN r ON r.conv_id = f.conv_id AND r.k = f.k + 1)
SELECT conv_id, turn, tokens, batch_no FROM f""",
    "q_spike_nms": """
WITH RECURSIVE s AS (SELECT event_id, user_id, epoch(ts) AS at_sec, value FROM events),
c AS (SELECT user_id, median(value) AS center, count(*) AS n FROM s GROUP BY user_id),
m AS (SELECT user_id, any_value(n) AS n, any_value(center) AS center, median(abs(value - center)) AS mad FROM s JOIN c USING (user_id) GROUP BY user_id),
p AS (SELECT user_id, event_id, at_sec, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, at_sec) AS k FROM s JOIN m USING (user_id) WHERE n >= 6 AND value > center + CASE WHEN mad = 0 THEN 1e-6 ELSE mad END),
f AS (
  SELECT user_id, 0 AS k, CAST([] AS DOUBLE[]) AS times, CAST([] AS BIGINT[]) AS ids FROM p WHERE k = 1
  UNION ALL
  SELECT p.user_id, CAST(p.k AS INTEGER), CASE WHEN len(times) < 6 AND len(list_filter(times, lambda t: abs(t - p.at_sec) < 86400)) = 0 THEN list_append(times, p.at_sec) ELSE times END,
    CASE WHEN len(times) < 6 AND len(list_filter(times, lambda t: abs(t - p.at_sec) < 86400)) = 0 THEN list_append(ids, p.event_id) ELSE ids END
  FROM f JOIN p ON p.user_id = f.user_id AND p.k = f.k + 1),
z AS (SELECT user_id, unnest(ids) AS event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY k DESC) AS n FROM f) WHERE n = 1)
SELECT p.user_id, p.event_id, p.at_sec, p.value FROM z JOIN p USING (user_id, event_id)""",
}
