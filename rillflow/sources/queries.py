"""Queries over sinks and sources on the carrier tables."""

from __future__ import annotations

import html
import io
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.plans.lineage import shared_dir
from rillflow.session import table
from rillflow.sources.knowledge import article_segments, parse_files, read_chunks, read_metadata, with_metadata
from rillflow.sources.tables import admit, append, apply_updates, delete_with_children, overlay, read_merged, stable_id, valid_feedback, with_ids

#: Chunks of one JSON list: lists grow in number with the table, not in length.
CHUNKS_A_FILE = 500
#: Word-processor files that are made before they are handed on.
FILES_AT_A_TIME = 64


def q_keyed_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with later versions that change a status and leave the rest."""
    stored = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.round("o_totalprice", 2).alias("o_totalprice"), F.lit(1).alias("version"))
    updates = stored.filter("o_orderkey % 7 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus"), F.lit(2).alias("version"))
    return apply_updates(stored, updates, "o_orderkey", "version").select("o_orderkey", "o_orderstatus", "o_totalprice", "version")


def q_valid_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").filter("event_id % 2 = 0").select("event_id")
    updates = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, "correct").when(F.col("event_id") % 3 == 1, "other").otherwise("missed").alias("feedback"))
    return valid_feedback(updates, events)[0].select("event_id", "feedback")


def q_cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, orders = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return delete_with_children(customers, orders, customers.filter("c_custkey % 10 = 3"), "c_custkey")[1].select("o_orderkey", "c_custkey")


def q_numbered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids are consecutive: their number, least, greatest and sum."""
    rows = with_ids(table(spark, sf_dir, "events").select("event_id"), 100, ["event_id"])
    return rows.agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high"), F.sum("id").alias("total"))


def q_vector_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", stable_id(F.col("source"), F.col("doc_id").cast("string"), F.lit("0")).alias("point_id"))


def q_text_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments between lines that begin with a capital A or T, over whole texts."""
    out = article_segments(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", "(?m)^([AT])")
    return out.groupBy("doc_id").agg(F.count("*").alias("n_segments"), F.min("start").alias("first_start"), F.sum(F.col("end") - F.col("start")).alias("n_chars"))


def q_knowledge_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk files with their documents' titles: blank texts are left out, a missing document is named by its file, unknown ones have no title."""
    folder = f"{shared_dir(spark)}/knowledge-{uuid.uuid4().hex}"
    item = F.struct(
        F.concat(F.lit("c"), F.col("item_id").cast("string")).alias("chunk_id"), F.when(F.col("item_id") % 3 != 0, F.concat(F.lit("d"), (F.col("item_id") % 3).cast("string"))).alias("document_id"),
        F.when(F.col("item_id") % 5 != 0, F.col("text")).otherwise(" ").alias("text"),
    )
    lists = table(spark, sf_dir, "benchmark").groupBy(F.floor(F.col("item_id") / CHUNKS_A_FILE).alias("file")).agg(F.to_json(F.collect_list(item)).alias("value"))
    lists.select("value").write.option("maxRecordsPerFile", 1).text(f"{folder}/chunks")
    entries = '- id: d1\n  title: "First"\n  institution: A\n- id: d9\n  title: Ninth'
    spark.createDataFrame([(entries,)], "value string").write.text(f"{folder}/sources")
    chunks = with_metadata(read_chunks(spark, f"{folder}/chunks", "*.txt"), read_metadata(spark, f"{folder}/sources"))
    named = F.when(F.col("document_id").startswith("part-"), "file").otherwise(F.col("document_id"))
    return chunks.select("chunk_id", named.alias("document_id"), F.coalesce("title", F.lit("-")).alias("title"), F.length("text").alias("n_chars"))


def _word_file(text: str) -> bytes:
    """A text as a word-processor file, a paragraph for each line."""
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{html.escape(line, quote=False)}</w:t></w:r></w:p>' for line in text.split("\n"))
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as files:
        files.writestr("word/document.xml", f"<w:document><w:body>{body}</w:body></w:document>")
    return box.getvalue()


def _as_word_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, text) as (path, content), a few files at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, FILES_AT_A_TIME):
            part = batch.slice(at, FILES_AT_A_TIME)
            content = [None if t is None else _word_file(t) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(content, pa.binary())], names=["path", "content"])


def q_document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as text files, word-processor files, files that are not allowed and broken ones; texts of more than 20,000 characters are cut."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kind = F.col("doc_id") % 4
    ending = F.when(kind < 2, ".txt").when(kind == 2, ".docx").otherwise(F.when(F.col("doc_id") % 8 == 3, ".docx").otherwise(".pdf"))
    named = docs.select(F.concat(F.lit("folder/"), F.col("doc_id").cast("string"), ending).alias("path"), "text", F.coalesce(kind == 2, F.lit(False)).alias("as_word"))
    files = named.filter("as_word").select("path", "text").mapInArrow(_as_word_files, "path string, content binary").unionByName(named.filter("not as_word").select("path", F.col("text").cast("binary").alias("content")))
    return parse_files(files, 20_000).select("filename", "status", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


def q_admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admit(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id").select("doc_id", "admitted")


def q_manual_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Automatic alerts, and later ones of an operator with a note, in one table whose columns grew."""
    path = f"{shared_dir(spark)}/alerts-{uuid.uuid4().hex}"
    e = table(spark, sf_dir, "events")
    append(e.filter("event_type = 'error'").select("event_id", F.lit(True).alias("auto")), path)
    append(e.filter("event_type = 'signup'").select("event_id", F.lit(False).alias("auto"), F.concat(F.lit("by hand "), "event_type").alias("note")), path)
    return read_merged(spark, path).select("event_id", "auto", F.coalesce("note", F.lit("-")).alias("note"))


def q_overridden_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    return overlay(e, e.filter("event_id % 7 = 0").select("event_id", F.lit("X").alias("event_type")), "event_id", ["event_type"])


QUERIES = {f.__name__: f for f in (q_knowledge_chunks, q_document_files, q_admitted, q_manual_alerts, q_overridden_rows, q_keyed_updates, q_valid_feedback, q_cascade_delete, q_numbered_rows, q_vector_payload, q_text_segments)}
ORACLE_SQL = {
    "q_knowledge_chunks": "SELECT 'c' || item_id AS chunk_id, CASE WHEN item_id % 3 = 0 THEN 'file' ELSE 'd' || item_id % 3 END AS document_id, CASE WHEN item_id % 3 = 1 THEN 'First' ELSE '-' END AS title, length(text) AS n_chars FROM benchmark WHERE item_id % 5 <> 0 AND trim(text) <> ''",
    "q_document_files": r"""
WITH d AS (
  SELECT doc_id, doc_id || CASE WHEN doc_id % 4 < 2 THEN '.txt' WHEN doc_id % 4 = 2 OR doc_id % 8 = 3 THEN '.docx' ELSE '.pdf' END AS filename,
    CASE WHEN doc_id % 4 < 2 THEN text WHEN doc_id % 4 = 2 THEN array_to_string(list_filter(string_split(text, chr(10)), lambda x: x <> ''), chr(10)) END AS t FROM documents),
u AS (SELECT filename, CASE WHEN regexp_matches(t, '\S') THEN t END AS t FROM d)
SELECT filename, CASE WHEN t IS NULL THEN 'error' WHEN length(t) > 20000 THEN 'cut' ELSE 'ready' END AS status, CAST(length(t[1:20000]) AS INTEGER) AS n_chars, md5(t[1:20000]) AS text_md5 FROM u""",
    "q_admitted": "SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 5 AS admitted FROM documents",
    "q_manual_alerts": "SELECT event_id, event_type = 'error' AS auto, CASE WHEN event_type = 'error' THEN '-' ELSE 'by hand signup' END AS note FROM events WHERE event_type IN ('error', 'signup')",
    "q_overridden_rows": "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'X' ELSE event_type END AS event_type FROM events",
    "q_keyed_updates": "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, round(o_totalprice, 2) AS o_totalprice, CASE WHEN o_orderkey % 7 = 0 THEN 2 ELSE 1 END AS version FROM orders",
    "q_valid_feedback": "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'correct' ELSE 'missed' END AS feedback FROM events WHERE event_id % 2 = 0 AND event_id % 3 <> 1",
    "q_cascade_delete": "SELECT o_orderkey, o_custkey AS c_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 = 3)",
    "q_numbered_rows": "SELECT count(*) AS n, CAST(100 AS BIGINT) AS low, CAST(99 + count(*) AS BIGINT) AS high, CAST(count(*) * (199 + count(*)) / 2 AS BIGINT) AS total FROM events",
    "q_vector_payload": "SELECT doc_id, sha256(source || ':' || doc_id || ':0') AS point_id FROM documents",
    "q_text_segments": r"""
WITH s AS (SELECT doc_id, length(text) AS n, [length(array_to_string(list_slice(string_split(text, chr(10)), 1, k - 1), chr(10))) + CASE WHEN k > 1 THEN 1 ELSE 0 END FOR k IN generate_series(1, len(string_split(text, chr(10)))) IF string_split(text, chr(10))[k][1] IN ('A', 'T')] AS starts FROM documents)
SELECT doc_id, len(starts) AS n_segments, CAST(list_min(starts) AS INTEGER) AS first_start, CAST(n - list_min(starts) AS BIGINT) AS n_chars FROM s WHERE len(starts) > 0""",
}
