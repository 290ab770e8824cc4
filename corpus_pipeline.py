"""The corpus pipeline: five stages from raw documents to packed token sequences.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and
read again as the next stage's documents.  All stages but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rillflow.llm.exact_dedup import drop_copies
from rillflow.llm.language_id import keep_identified
from rillflow.llm.mixing import draw_mix
from rillflow.llm.near_dedup import keep_representatives
from rillflow.llm.packing import pack
from rillflow.plans.lineage import materialize
from rillflow.session import table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; texts without a letter, null texts and undecided ones go.

    Each row is judged by its own text, so repeated rows and null ids are kept or
    go like others; very long texts are read whole.  Without a labelled document only
    texts without a letter go.  An empty table stays empty.
    """
    return _columns(keep_identified(docs))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the largest id.

    A null text counts as empty, a null id stays only where its group has no other;
    a row repeated with its id and text stays once.  An empty table stays empty.
    """
    return _columns(drop_copies(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates, the one with the smallest id.

    Null and empty texts and null ids are near nothing and stay; of rows repeated with
    one id all stay or go.  An empty table stays empty.
    """
    return _columns(keep_representatives(docs))


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents drawn to their source's target; a document drawn k times has k rows.

    A null source is a source of its own; documents without words are drawn once;
    rows repeated with one id and size are drawn alike.  An empty table stays empty.
    """
    return _columns(draw_mix(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and offsets.

    A null text is one token, a row drawn several times is packed as often, a long
    text is cut to pieces of a whole sequence.  An empty table gives no piece.
    """
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mix_sources", mix_to_weights),
    ("pack", pack_sequences),
]

#: Trained models, signatures and tokens are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each one's result written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
