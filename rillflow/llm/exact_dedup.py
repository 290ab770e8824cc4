"""Exact deduplication by a tree merge of sorted digest runs, in DataFrame operations only.

Every document is dealt to one of the runs by a hash of its id; there are so many
runs that one holds ``ROWS_PER_RUN`` rows, and at least ``RUNS``.  A run is
the sorted list of its distinct digests, each with the identifier that stays
and the number of documents.  In binomial rounds ``fan_in`` neighbouring runs
are merged: rows of one digest meet, the best identifier stays and the counts
add up, until one run is left.  The survivors then go back down the tree to the
first runs and from there to the documents, so that a text which a third of all
rows share is never brought together in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillflow.plans.lineage import materialize

RUNS = 64
ROWS_PER_RUN = 1_000_000
FAN_IN = 4
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A digest row is equal to another one only if hash, length and a second, independent hash agree.
_KEY = ["text_sha256", "n_bytes", "verify"]


def normalized(text: Column) -> Column:
    """The text with A-Z lower-cased; null counts as empty.  Texts of ASCII alone take the faster general function."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per document: id, the hash that deals it out and the digest key of its normalised text."""
    return (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), normalized(F.col(text_col)).alias("norm"))
        .select(
            "doc_id",
            F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1)), F.lit(17)).alias("deal"),
            F.sha2("norm", 256).alias("text_sha256"),
            F.octet_length("norm").alias("n_bytes"),
            F.xxhash64("norm").alias("verify"),
        )
    )


def merge_runs(level: DataFrame, fan_in: int) -> DataFrame:
    """One round: each ``fan_in`` neighbouring runs become one sorted run without repeated digests."""
    w = Window.partitionBy("run", *_KEY)
    return (
        level.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
        .withColumn("place", F.row_number().over(w.orderBy(F.col("keep_id").desc_nulls_last())))
        .withColumn("group_size", F.sum("group_size").over(w))
        .filter("place = 1")
        .drop("place")
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = FAN_IN, rows_per_run: int = ROWS_PER_RUN) -> DataFrame:
    """Return one row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; a null text counts as
    empty.  Of equal texts the largest doc_id stays.  A null doc_id stays only
    where a group has no other id (keep_id is null then).  Rows repeated with the
    same id and text are one document: all of them have the same ``kept``, and
    group_size counts every row.  An empty table gives an empty result; further
    columns of ``docs`` are ignored whatever their names.
    """
    dealt = materialize(digests(docs, id_col, text_col), "digests")
    runs = max(RUNS, -(-dealt.count() // rows_per_run))
    leaf = dealt.withColumn("run", F.pmod("deal", F.lit(runs)).cast("int")).drop("deal")
    first = leaf.groupBy("run", *_KEY).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    level, left = first, runs
    while left > 1:
        level, left = merge_runs(level, fan_in), -(-left // fan_in)
    survivors = level.drop("run")
    # down the tree: at most one row per digest and first run, then the documents of that run
    placed = first.select("run", *_KEY).join(survivors, _KEY)
    return leaf.join(placed, ["run", *_KEY]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns; a row repeated with the same id and text is returned once.

    Null texts are empty ones and null ids stay only where their group has no
    other id.  An empty table gives an empty result.
    """
    name = lambda id_, sha: F.concat_ws(":", F.coalesce(id_.cast("string"), F.lit("")), sha)
    stays = exact_dedup(docs, id_col, text_col).filter("kept").select(name(F.col("keep_id"), F.col("text_sha256")).alias("name")).distinct()
    marked = docs.select(name(F.col(id_col).cast("long"), F.sha2(normalized(F.col(text_col)), 256)).alias("name"), F.struct("*").alias("row"))
    # one key for both steps: the rows are dealt out once
    return marked.join(stays.hint("merge"), "name", "left_semi").dropDuplicates(["name"]).select("row.*")
