"""Store queries: newest rows, time ranges, pages, counts per group, and keyed tables without in-place updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillflow.functions.values import SEVERITIES
from rillflow.operators.sessions import seconds
from rillflow.session import table

MAX_PAGE = 200
CHAT_ROLES = ("user", "assistant")


def newest(rows: DataFrame, at: str, tie: str, n: int, where: Column | None = None) -> DataFrame:
    """The ``n`` newest rows (of those that satisfy ``where``); equal times are ordered by ``tie``, descending."""
    return (rows if where is None else rows.filter(where)).orderBy(F.col(at).desc_nulls_last(), F.col(tie).desc_nulls_last()).limit(n)


def timeline(rows: DataFrame, at: str, low: float, high: float, source: Column | None = None) -> DataFrame:
    """Rows with a time in [low, high], both ends included; a source condition excludes rows whose source is null."""
    inside = F.col(at).between(low, high)
    return rows.filter(inside if source is None else inside & source)


def page(rows: DataFrame, order: list[Column], limit: int, offset: int) -> DataFrame:
    """One page; the limit is held within 1 to ``MAX_PAGE`` and the offset is not negative."""
    return rows.orderBy(*order).offset(max(0, offset)).limit(min(MAX_PAGE, max(1, limit)))


def count_children(parents: DataFrame, children: DataFrame, key: str, alias: str) -> DataFrame:
    """Parents with the number of their children, 0 included; children are counted before the join."""
    counts = children.groupBy(key).agg(F.count("*").alias(alias))
    return parents.join(counts, key, "left").withColumn(alias, F.coalesce(alias, F.lit(0)))


def last_messages(messages: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """Each key's last ``n`` messages, with ``place`` from 1 in chronological order."""
    back = Window.partitionBy(key).orderBy(F.col(order).desc())
    kept = messages.withColumn("__back", F.row_number().over(back)).filter(F.col("__back") <= n)
    return kept.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(order))).drop("__back")


def latest_by_key(versions: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The current row of every key in an append-only table: the last one by ``order``."""
    w = Window.partitionBy(*key).orderBy(*order)
    return versions.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def insert_or_ignore(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The new rows whose key is not stored yet; of repeated new keys the first by all columns."""
    fresh = new.join(stored.select(key).distinct(), key, "left_anti")
    return latest_by_key(fresh, [key], [F.col(c).asc() for c in new.columns if c != key] or [F.col(key)])


def level_histogram(rows: DataFrame, level: str, levels: tuple[str, ...] = SEVERITIES) -> DataFrame:
    """Rows per level, with 0 for levels that do not occur."""
    spark = rows.sparkSession
    every = spark.range(1).select(F.posexplode(F.array(*map(F.lit, levels))).alias("rank", level))
    return every.join(rows.groupBy(level).agg(F.count("*").alias("n")), level, "left").select(level, "rank", F.coalesce("n", F.lit(0)).alias("n"))


def value_level(value: Column) -> Column:
    """The carrier's risk level: quarters of its value range."""
    return F.when(value < 125, "dusuk").when(value < 250, "orta").when(value < 375, "yuksek").otherwise("kritik")


def q_recent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("level", value_level(F.col("value")))
    return newest(events, "ts", "event_id", 50, F.col("level") == "kritik").select("event_id", "user_id", "event_type", "level", F.round("value", 4).alias("value"))


def q_timeline_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("at_sec", seconds(F.col("ts")))
    return timeline(events, "at_sec", 1704499200.0, 1705104000.0, F.col("event_type") == "error").select("event_id", "user_id", F.round("at_sec", 3).alias("at_sec"))


def q_history_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
    return page(orders, [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()], 500, 20).select("o_orderkey", "o_custkey", F.round("o_totalprice", 2).alias("o_totalprice"))


def q_conv_message_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = table(spark, sf_dir, "conversations")
    return count_children(messages.select("conv_id").distinct(), messages.filter(F.col("role").isin(*CHAT_ROLES)), "conv_id", "n_messages")


def q_ready_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id", "toxic")
    return table(spark, sf_dir, "documents").filter("lang = 'en'").select("doc_id", "source", "n_chars").join(ready, "doc_id")


def q_last_n_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = table(spark, sf_dir, "conversations").filter(F.col("role").isin(*CHAT_ROLES))
    return last_messages(messages, "conv_id", "turn", 8).select("conv_id", "turn", "role", "place")


def q_type_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type")


def q_level_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").filter("event_type = 'signup' and value < 300").select(value_level(F.col("value")).alias("level"))
    return level_histogram(events, "level")


def q_event_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Worst level, number of rows, critical rows and mean value of every user."""
    level = value_level(F.col("value"))
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), level)
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.max(rank).cast("int").alias("worst_rank"), F.count("*").alias("n"), F.count_if(level == "kritik").alias("n_critical"), F.round(F.sum(F.col("value").cast("decimal(18,4)")).cast("double") / F.count("value"), 4).alias("mean_value")
    )


def q_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed update on an append-only table: each user's last row."""
    events = table(spark, sf_dir, "events")
    return latest_by_key(events, ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", "event_id", "event_type")


def q_insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents are stored; which documents would be inserted."""
    stored = table(spark, sf_dir, "labels").select("doc_id")
    return insert_or_ignore(stored, table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")


def q_name_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct sorted event names of every user, joined."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("names"), F.countDistinct("event_type").alias("n_names"))


_LEVEL = "CASE WHEN value < 125 THEN 'dusuk' WHEN value < 250 THEN 'orta' WHEN value < 375 THEN 'yuksek' ELSE 'kritik' END"
QUERIES = {f.__name__: f for f in (q_recent_events, q_timeline_range, q_history_page, q_conv_message_counts, q_ready_chunks, q_last_n_messages, q_type_histogram, q_level_histogram, q_event_summary, q_latest_state, q_insert_ignore, q_name_lists)}
ORACLE_SQL = {
    "q_recent_events": f"SELECT event_id, user_id, event_type, {_LEVEL} AS level, round(value, 4) AS value FROM events WHERE {_LEVEL} = 'kritik' ORDER BY ts DESC, event_id DESC LIMIT 50",
    "q_timeline_range": "SELECT event_id, user_id, round(epoch(ts), 3) AS at_sec FROM events WHERE epoch(ts) BETWEEN 1704499200.0 AND 1705104000.0 AND event_type = 'error'",
    "q_history_page": "SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 200 OFFSET 20",
    "q_conv_message_counts": "SELECT c.conv_id, count(m.conv_id) AS n_messages FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN (SELECT conv_id, turn FROM conversations WHERE role IN ('user', 'assistant')) m USING (conv_id) GROUP BY c.conv_id",
    "q_ready_chunks": "SELECT d.doc_id, d.source, d.n_chars, l.toxic FROM documents d JOIN labels l USING (doc_id) WHERE d.lang = 'en' AND l.quality = 1",
    "q_last_n_messages": """
WITH m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations WHERE role IN ('user', 'assistant'))
SELECT conv_id, turn, role, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS place FROM m WHERE back <= 8""",
    "q_type_histogram": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type",
    "q_level_histogram": f"""
WITH e AS (SELECT {_LEVEL} AS level FROM events WHERE event_type = 'signup' AND value < 300),
l AS (SELECT * FROM (VALUES ('dusuk', 0), ('orta', 1), ('yuksek', 2), ('kritik', 3)) AS t(level, rank))
SELECT l.level, l.rank, count(e.level) AS n FROM l LEFT JOIN e USING (level) GROUP BY l.level, l.rank""",
    "q_event_summary": f"""
WITH e AS (SELECT *, {_LEVEL} AS level FROM events)
SELECT user_id, max(list_position(['dusuk', 'orta', 'yuksek', 'kritik'], level)) AS worst_rank, count(*) AS n, count(*) FILTER (level = 'kritik') AS n_critical, round(CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) / count(value), 4) AS mean_value
FROM e GROUP BY user_id""",
    "q_latest_state": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1",
    "q_insert_ignore": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "q_name_lists": "SELECT user_id, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS names, count(DISTINCT event_type) AS n_names FROM events GROUP BY user_id",
}
