"""Evaluation of detections: precision, recall and F1 by type, macro and micro, with latencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.session import table


def type_counts(clips: DataFrame, expected: str, detected: str) -> DataFrame:
    """True positives, false positives and false negatives of every type over sets of expected and detected types."""
    member = clips.select(F.explode(F.array_union(expected, detected)).alias("type"), F.col(expected).alias("e"), F.col(detected).alias("d"))
    inside = lambda c: F.expr(f"array_contains({c}, type)")
    return member.groupBy("type").agg(F.count_if(inside("e") & inside("d")).alias("tp"), F.count_if(~inside("e") & inside("d")).alias("fp"), F.count_if(inside("e") & ~inside("d")).alias("fn"))


def scores(counts: DataFrame) -> DataFrame:
    """Add precision, recall and f1; 0 where there is nothing to divide by."""
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.withColumn("precision", p).withColumn("recall", r).withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def summary(clips: DataFrame, expected: str, detected: str, latency: str) -> DataFrame:
    """One row: macro and micro scores, mean and median latency of measured clips."""
    counts = type_counts(clips, expected, detected)
    macro = scores(counts).agg(F.avg("f1").alias("macro_f1"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    micro = scores(macro).withColumnRenamed("f1", "micro_f1")
    timed = clips.filter(F.col(latency) > 0).agg(F.avg(latency).alias("mean_latency"), F.median(latency).alias("median_latency"))
    return micro.withColumn("one", F.lit(1)).join(timed.withColumn("one", F.lit(1)), "one").drop("one")  # one row each


def carrier_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    expected = F.array_compact(F.array(F.when(F.col("quality") == 1, "good"), F.when(F.col("toxic") == 1, "toxic"), F.lit("text")))
    detected = F.array_compact(F.array(F.when(F.col("n_chars") > 1000, "good"), F.when(F.col("doc_id") % 5 == 0, "toxic"), F.when(F.col("n_chars") > 50, "text")))
    return labels.join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id").select("doc_id", expected.alias("expected"), detected.alias("detected"), (F.col("n_chars") % 400).cast("double").alias("latency"))


def q_prf1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(type_counts(carrier_clips(spark, sf_dir), "expected", "detected")).select("type", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def q_prf1_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = summary(carrier_clips(spark, sf_dir), "expected", "detected", "latency")
    return s.select("tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("macro_f1", "precision", "recall", "micro_f1", "mean_latency", "median_latency")])


_COUNTS = """
c AS (SELECT doc_id, list_filter([CASE WHEN quality = 1 THEN 'good' END, CASE WHEN toxic = 1 THEN 'toxic' END, 'text'], lambda x: x IS NOT NULL) AS e,
  list_filter([CASE WHEN n_chars > 1000 THEN 'good' END, CASE WHEN doc_id % 5 = 0 THEN 'toxic' END, CASE WHEN n_chars > 50 THEN 'text' END], lambda x: x IS NOT NULL) AS d, n_chars % 400 AS latency FROM labels JOIN documents USING (doc_id)),
u AS (SELECT unnest(list_distinct(e || d)) AS type, e, d FROM c),
n AS (SELECT type, count(*) FILTER (list_contains(e, type) AND list_contains(d, type)) AS tp, count(*) FILTER (NOT list_contains(e, type)) AS fp, count(*) FILTER (NOT list_contains(d, type)) AS fn FROM u GROUP BY type),
s AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall FROM n),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM s)
"""
QUERIES = {"q_prf1": q_prf1, "q_prf1_summary": q_prf1_summary}
ORACLE_SQL = {
    "q_prf1": f"WITH {_COUNTS} SELECT type, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f",
    "q_prf1_summary": f"""WITH {_COUNTS}, m AS (SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, avg(f1) AS macro_f1 FROM f)
SELECT tp, fp, fn, round(macro_f1, 6) AS macro_f1, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS micro_f1,
  (SELECT round(avg(latency), 6) FROM c WHERE latency > 0) AS mean_latency, (SELECT round(median(latency), 6) FROM c WHERE latency > 0) AS median_latency FROM m""",
}
