"""Named queries with typed arguments over events and knowledge, and actions that are recorded instead of taken."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.functions.text import jaccard, json_object
from rillflow.operators.retrieval import substring_topk
from rillflow.operators.series import carrier_series, robust_spikes
from rillflow.operators.sessions import seconds
from rillflow.plans.parameters import Parameters, bounded
from rillflow.session import table


@dataclass(frozen=True)
class Recent(Parameters):
    """The newest events, of one type or of all."""

    event_type: str = bounded("")
    limit: int = bounded(5, 1, 50)


@dataclass(frozen=True)
class Lookup(Parameters):
    """Knowledge that answers a question."""

    question: str = bounded("")
    top_k: int = bounded(3, 1, 20)

    def between(self) -> str | None:
        return None if self.question.strip() else "question must not be blank"


@dataclass(frozen=True)
class Stretch(Parameters):
    """Events between two times, in order."""

    start_ts: float = bounded(0.0, 0.0)
    end_ts: float = bounded(0.0, 0.0)

    def between(self) -> str | None:
        return None if self.start_ts <= self.end_ts else "start_ts must not be after end_ts"


@dataclass(frozen=True)
class Verification(Parameters):
    """What speaks for a claim: events of a type and knowledge that has its words."""

    claim: str = bounded("")
    event_type: str = bounded("")


@dataclass(frozen=True)
class Stores:
    """What the tools read: events (event_id, event_type, at_sec, value) and knowledge (doc_id, text)."""

    events: DataFrame
    knowledge: DataFrame


def recent(stores: Stores, args: Recent) -> DataFrame:
    rows = stores.events.filter(F.col("event_type") == args.event_type) if args.event_type else stores.events
    return rows.orderBy(F.desc("at_sec"), F.desc("event_id")).limit(args.limit).select(F.col("event_id").alias("id"), F.col("event_type").alias("note"))


def lookup(stores: Stores, args: Lookup) -> DataFrame:
    found = substring_topk(stores.knowledge, "text", "doc_id", args.question, args.top_k)
    return found.select(F.col("doc_id").alias("id"), F.concat(F.lit("score "), F.col("score").cast("string")).alias("note"))


def stretch(stores: Stores, args: Stretch) -> DataFrame:
    return stores.events.filter(F.col("at_sec").between(args.start_ts, args.end_ts)).select(F.col("event_id").alias("id"), F.col("event_type").alias("note"))


def verify(stores: Stores, args: Verification) -> DataFrame:
    """One row: how many events of the type there are, and whether those or knowledge support the claim."""
    events = stores.events.filter(F.col("event_type") == args.event_type) if args.event_type else stores.events.limit(0)
    known = substring_topk(stores.knowledge, "text", "doc_id", args.claim, 1)
    both = events.select(F.lit(1).alias("event"), F.lit(0).alias("known")).unionByName(known.select(F.lit(0).alias("event"), F.lit(1).alias("known")))
    n = both.agg(F.coalesce(F.sum("event"), F.lit(0)).alias("n_events"), F.coalesce(F.sum("known"), F.lit(0)).alias("n_known"))
    some = (F.col("n_events") > 0).cast("int") + (F.col("n_known") > 0).cast("int")
    return n.select(F.col("n_events").alias("id"), F.when(some == 2, "supported").when(some == 1, "partly supported").otherwise("unsupported").alias("note"))


TOOLS: dict[str, tuple[type[Parameters], Callable[[Stores, Parameters], DataFrame]]] = {"recent": (Recent, recent), "lookup": (Lookup, lookup), "stretch": (Stretch, stretch), "verify": (Verification, verify)}
ACTIONS = ("notify", "alarm", "ticket")


def call(stores: Stores, name: str, enabled: tuple[str, ...] = tuple(TOOLS), **args: object) -> DataFrame:
    """(tool, id, note) of a tool's answer.  Unknown or disabled tools, unknown arguments, and values of a wrong type or range are refused before any job starts."""
    if name not in TOOLS or name not in enabled:
        raise ValueError(f"no such tool: {name}")
    kind, run = TOOLS[name]
    return run(stores, kind(**args)).select(F.lit(name).alias("tool"), F.col("id").cast("long").alias("id"), "note")


def record_actions(rows: DataFrame, id_col: str, action: str) -> DataFrame:
    """(id, action, status): actions as rows of a table; nothing outside is called."""
    if action not in ACTIONS:
        raise ValueError(f"no such action: {action}")
    return rows.select(id_col, F.lit(action).alias("action"), F.lit("simulated").alias("status"))


def _stores(spark: SparkSession, sf_dir: str) -> Stores:
    events = table(spark, sf_dir, "events").select("event_id", "event_type", seconds(F.col("ts")).alias("at_sec"), "value")
    return Stores(events, table(spark, sf_dir, "documents").select("doc_id", "text"))


QUESTION = "which license covers this token work"


def q_tool_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tool once, over all events and documents."""
    stores = _stores(spark, sf_dir)
    span = stores.events.agg(F.min("at_sec").alias("low"), F.max("at_sec").alias("high")).first()
    day = {"start_ts": float(span["low"]), "end_ts": float(span["low"]) + 86400.0} if span["low"] is not None else {}
    answers = [call(stores, "recent", event_type="error", limit=7), call(stores, "lookup", question=QUESTION, top_k=4), call(stores, "stretch", **day), call(stores, "verify", claim=QUESTION, event_type="error")]
    return answers[0].unionByName(answers[1]).unionByName(answers[2]).unionByName(answers[3])


def q_recorded_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _stores(spark, sf_dir).events
    return record_actions(events.filter("value >= 400"), "event_id", "alarm").unionByName(record_actions(events.filter("event_type = 'error' and value < 400"), "event_id", "notify"))


def q_appended_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list of errors with confirmed sudden events appended, which have columns of their own."""
    series = carrier_series(spark, sf_dir)
    errors = series.filter("event_type = 'error'").select("event_id", "user_id", F.lit("error").alias("origin"))
    sudden = robust_spikes(series, ["user_id"], "value", 2.0).select("event_id", "user_id", F.lit("sudden").alias("origin"), F.round("limit", 4).alias("limit"))
    return errors.unionByName(sudden, allowMissingColumns=True)


def q_word_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each message's likeness to the next one of its conversation."""
    m = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    after = m.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("other"))
    return m.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.round(jaccard(F.col("text"), F.col("other")), 6).alias("likeness"))


def q_json_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first balanced object of replies that hold the events' properties among other text, nested, or not at all."""
    p = F.col("props")
    reply = (
        F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("Result: ```json\n"), p, F.lit("\n``` and { no more")))
        .when(F.col("event_id") % 4 == 1, F.concat(F.lit('{"outer": '), p, F.lit(', "text": "a } b"} tail {}'))).when(F.col("event_id") % 4 == 2, F.concat(F.lit("{broken "), p)).otherwise("nothing")
    )
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(json_object(reply), F.lit("-")).alias("found"))


def q_event_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of events and of their weeks, from seconds since the epoch, per user."""
    at = seconds(F.col("ts"))
    e = table(spark, sf_dir, "events").select("user_id", F.date_from_unix_date(F.floor(at / 86400).cast("int")).alias("day"))
    return e.groupBy("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), F.date_format(F.date_trunc("week", "day"), "yyyy-MM-dd").alias("week")).agg(F.count("*").alias("n"))


_WORDS = "list_distinct(list_filter(string_split_regex(lower({0}), '\\s+'), lambda x: x <> ''))"
_PARTS = [w for w in QUESTION.split() if len(w) > 3]
_SCORE = " + ".join(f"CAST(contains(lower(text), '{w}') AS INTEGER)" for w in _PARTS)
QUERIES = {f.__name__: f for f in (q_tool_answers, q_recorded_actions, q_appended_spikes, q_word_jaccard, q_json_objects, q_event_dates)}
ORACLE_SQL = {
    "q_tool_answers": f"""
WITH e AS (SELECT event_id, event_type, epoch(ts) AS at_sec FROM events),
k AS (SELECT doc_id, {_SCORE} AS score FROM documents),
v AS (SELECT (SELECT count(*) FROM e WHERE event_type = 'error') AS n, (SELECT count(*) FROM k WHERE score > 0) AS known)
SELECT 'recent' AS tool, event_id AS id, event_type AS note FROM (SELECT * FROM e WHERE event_type = 'error' ORDER BY at_sec DESC, event_id DESC LIMIT 7)
UNION ALL SELECT 'lookup', doc_id, 'score ' || score FROM (SELECT * FROM k WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 4)
UNION ALL SELECT 'stretch', event_id, event_type FROM e WHERE at_sec <= (SELECT min(at_sec) FROM e) + 86400
UNION ALL SELECT 'verify', n, CASE WHEN n > 0 AND known > 0 THEN 'supported' WHEN n > 0 OR known > 0 THEN 'partly supported' ELSE 'unsupported' END FROM v""",
    "q_recorded_actions": "SELECT event_id, CASE WHEN value >= 400 THEN 'alarm' ELSE 'notify' END AS action, 'simulated' AS status FROM events WHERE value >= 400 OR event_type = 'error'",
    "q_appended_spikes": """
WITH c AS (SELECT user_id, median(value) AS center, count(*) AS n FROM events GROUP BY user_id),
m AS (SELECT user_id, any_value(n) AS n, any_value(center) AS center, median(abs(value - center)) AS mad FROM events JOIN c USING (user_id) GROUP BY user_id)
SELECT event_id, user_id, 'error' AS origin, NULL AS "limit" FROM events WHERE event_type = 'error'
UNION ALL SELECT event_id, user_id, 'sudden', round(center + 2 * CASE WHEN mad = 0 THEN 1e-6 ELSE mad END, 4) FROM events JOIN m USING (user_id) WHERE n >= 6 AND value > center + 2 * CASE WHEN mad = 0 THEN 1e-6 ELSE mad END""",
    "q_word_jaccard": f"""
WITH w AS (SELECT conv_id, turn, {_WORDS.format("text")} AS ws FROM conversations),
p AS (SELECT a.conv_id, a.turn, len(list_intersect(a.ws, b.ws)) AS common, len(a.ws) + len(b.ws) AS words FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
SELECT conv_id, turn, CASE WHEN words = common THEN 0.0 ELSE round(common / (words - common), 6) END AS likeness FROM p""",
    "q_json_objects": """SELECT event_id, CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN '{"outer": ' || props || ', "text": "a } b"}' WHEN 2 THEN props ELSE '-' END AS found FROM events""",
    "q_event_dates": "SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, count(*) AS n FROM events GROUP BY ALL",
}
