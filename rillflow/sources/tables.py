"""Sinks without in-place updates: append, keyed versions, feedback, deletion, and a manifest that guards an index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillflow.operators.ranges import ranked
from rillflow.operators.stores import latest_by_key

FEEDBACK = ("correct", "false_alarm", "missed")


def append(rows: DataFrame, path: str) -> None:
    """Add rows to a table of Parquet files; new columns are merged on reading."""
    rows.write.mode("append").parquet(path)


def read_merged(spark: SparkSession, path: str) -> DataFrame:
    """A table whose columns grew over time: older rows have nulls in newer columns."""
    return spark.read.option("mergeSchema", True).parquet(path)


def with_ids(rows: DataFrame, first: int, order: list[str], buckets: int = 64) -> DataFrame:
    """Add consecutive ``id`` numbers from ``first``: rows are counted per hash bucket and numbered inside it, so no task sees all rows."""
    keyed = rows.withColumn("__b", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    ahead = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    counts = keyed.groupBy("__b").agg(F.count("*").alias("__c")).withColumn("__ahead", F.coalesce(F.sum("__c").over(ahead), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("__b").orderBy(*order))
    return keyed.join(counts.select("__b", "__ahead"), "__b").withColumn("id", F.col("__ahead") + own - 1 + first).drop("__b", "__ahead")


def apply_updates(stored: DataFrame, updates: DataFrame, key: str, version: str) -> DataFrame:
    """Keyed updates as new versions: each key's newest row, with stored values where an update has nulls."""
    both = stored.unionByName(updates, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(F.col(version).desc())
    filled = both.select(key, version, *[F.first(c, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)).alias(c) for c in both.columns if c not in (key, version)])
    return latest_by_key(filled, [key], [F.col(version).desc()])


def overlay(rows: DataFrame, overrides: DataFrame, ordinal: str, columns: list[str]) -> DataFrame:
    """Rows with per-row overrides by ordinal; more overrides than rows is an error."""
    marked = overrides.select(ordinal, *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__set"))
    joined = rows.withColumn("__row", F.lit(True)).join(marked, ordinal, "full")
    checked = F.when(F.col("__row").isNull(), F.raise_error(F.lit("an override has no row")).cast("boolean")).otherwise(F.lit(True))
    return joined.filter(checked).select(*[F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns])


def valid_feedback(updates: DataFrame, events: DataFrame, key: str = "event_id") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) feedback: of an allowed kind and for a stored event."""
    known = updates.join(events.select(F.col(key).alias("__known")).distinct(), F.col(key) == F.col("__known"), "left")
    good = F.col("feedback").isin(*FEEDBACK) & F.col("__known").isNotNull()
    marked = known.withColumn("__ok", F.coalesce(good, F.lit(False)))
    return marked.filter("__ok").drop("__known", "__ok"), marked.filter("not __ok").drop("__known", "__ok")


def delete_with_children(parents: DataFrame, children: DataFrame, gone: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Parents and children without the given parent keys."""
    keys = gone.select(key).distinct()
    return parents.join(keys, key, "left_anti"), children.join(keys, key, "left_anti")


def admit(files: DataFrame, group: str, order: str, most: int = 5) -> DataFrame:
    """Add ``admitted``: at most ``most`` files per group, in order of arrival."""
    return ranked(files, [group], [F.col(order).asc()], "admitted").withColumn("admitted", F.col("admitted") <= most)


def stable_id(*parts: Column) -> Column:
    """A deterministic id of its parts for idempotent upserts."""
    return F.sha2(F.concat_ws(":", *parts), 256)


def content_hash(rows: DataFrame, id_col: str, text: str) -> str:
    """One digest of a whole corpus, independent of row order: the digest of the per-row digests' sums."""
    digest = F.sha2(F.concat_ws("\x1f", F.col(id_col).cast("string"), F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\r\n", "\n")), 256)
    parts = [F.sum(F.conv(F.substring(digest, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")).alias(f"p{k}") for k in range(4)]
    row = rows.agg(F.count("*").alias("n"), *parts).select(F.sha2(F.concat_ws("|", "n", *[f"p{k}" for k in range(4)]), 256)).first()
    return row[0]


def manifest(spark: SparkSession, model: str, dimension: int, normalised: bool, metric: str, digest: str, n: int) -> DataFrame:
    """One row that says what an index was built from."""
    return spark.createDataFrame([(model, dimension, normalised, metric, digest, n)], "model string, dimension int, normalised boolean, metric string, digest string, n long")


def valid_manifest(stored: DataFrame, expected: DataFrame) -> DataFrame:
    """The stored manifest if it equals the expected one in every field, else no row; queries refuse an empty one."""
    return stored.join(expected, stored.columns, "left_semi")


def reason_summary(rows: DataFrame, reason: str, id_col: str) -> DataFrame:
    """Rows per reason and ids that occur more than once in it."""
    per = rows.groupBy(reason, id_col).agg(F.count("*").alias("k"))
    return per.groupBy(reason).agg(F.sum("k").alias("n"), F.count_if(F.col("k") > 1).alias("n_repeated_ids"))
