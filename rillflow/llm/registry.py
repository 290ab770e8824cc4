"""The corpus queries op1 to op13 and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rillflow.llm import sql
from rillflow.llm.collocations import collocations
from rillflow.llm.exact_dedup import exact_dedup
from rillflow.llm.language_id import language_id
from rillflow.llm.licenses import scan_licenses
from rillflow.llm.mixing import mix
from rillflow.llm.near_dedup import near_duplicates
from rillflow.llm.packing import pack
from rillflow.llm.pivot_links import near_vectors
from rillflow.llm.prefix_trie import prefix_trie
from rillflow.llm.repeated_bytes import remove_repeated_bytes
from rillflow.llm.secrets import scan_secrets
from rillflow.llm.sentence_spans import remove_repeated_spans
from rillflow.llm.syncmers import fingerprints
from rillflow.session import table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op3_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"), keep_all=None)


def op4_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(table(spark, sf_dir, "documents")).drop("kept")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op8_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_spans(table(spark, sf_dir, "documents"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op12_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_exact_dedup, op2_language_id, op3_syncmer_fingerprints, op4_repeated_bytes, op5_secret_scan, op6_mix_sources, op7_best_fit_packing, op8_sentence_spans, op9_near_duplicates, op10_license_scan, op11_collocations, op12_near_vectors, op13_prefix_trie)}


def oracle_sql() -> dict[str, str]:
    return dict(sql.ORACLE_SQL)
