"""Language identification with a bidirectional gated recurrent network over bytes.

A text's bytes (A-Z lower-cased, every white space a blank) are cut to windows of
``WINDOW`` bytes that run across words.  The network labels every byte position of
a window with a probability for each language, from all bytes before and after it
in the window, and a document's probability is the mean over all its positions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillflow.llm.bigru import WINDOW, BiGru
from rillflow.llm.shingles import blocks

UNKNOWN = "und"
HELD_OUT = 2
#: Bounds of the training sample: the languages with most labelled documents, documents of each, and characters of each document.
MOST_LANGS = 200
TRAIN_DOCS = 250
TRAIN_CHARS = 8_192
STEPS = 300
BATCH = 96
#: Lengths of the windows that training draws, so that short texts are learned as well.
SHORTEST, LONGEST = 4, 64
RATE = 0.01
BLOCK_BYTES = 1 << 20
#: The stage rejects documents below this share of the lowest score of a rightly named held-out document, and never from the second value on.
SHARE_OF_LOWEST, MOST_LIMIT = 0.8, 0.3
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[*range(0x09, 0x0E)]] = 0x20


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4


def folded(text: bytes) -> np.ndarray:
    return _FOLD[np.frombuffer(text, dtype=np.uint8)]


def has_letter(text: bytes) -> bool:
    return any(map(str.isalpha, text.decode()))


def windows_of(block: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows (n, WINDOW), their lengths, the text of each) of a block of texts."""
    joined = folded(b"".join(block))
    sizes = np.fromiter(map(len, block), dtype=np.int64, count=len(block))
    parts = -(-sizes // WINDOW)
    text = np.repeat(np.arange(len(block)), parts)
    ends = np.cumsum(sizes)
    at = (ends - sizes)[text] + (np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)) * WINDOW
    lengths = np.minimum(WINDOW, ends[text] - at)
    windows = joined[np.minimum(at[:, None] + np.arange(WINDOW), max(0, len(joined) - 1))] if len(text) else np.empty((0, WINDOW), np.uint8)
    return windows, lengths, text


def sample(docs: DataFrame, n: int, id_col: str, text_col: str, lang_col: str) -> list:
    """(doc_id, lang, text) of at most ``n`` labelled documents outside the held-out fold of each of the ``MOST_LANGS`` commonest languages, by smallest hash; null ids are not taken.

    Of a text, at most ``TRAIN_CHARS`` characters come to the driver, from a place that a hash chooses.
    """
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    labelled = named.filter((fold(F.col("doc_id")) != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    common = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGS).select("lang")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id")
    chosen = labelled.select("doc_id", "lang").distinct().join(F.broadcast(common), "lang").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)
    at = F.pmod(F.xxhash64("doc_id", F.lit(6)), F.greatest(F.lit(1), F.length("text") - TRAIN_CHARS)).cast("int") + 1
    rows = labelled.join(F.broadcast(chosen.select("doc_id", "lang")), ["doc_id", "lang"])  # MOST_LANGS * n rows at most
    return sorted(rows.select("doc_id", "lang", F.substr("text", at, F.lit(TRAIN_CHARS)).alias("text")).dropDuplicates(["doc_id", "lang"]).collect(), key=lambda r: (r["lang"], r["doc_id"]))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], BiGru] | None:
    """Train on a sample of labelled documents outside the held-out fold.  A language of very little text is drawn in windows of its own length and shortens no other's."""
    texts: dict[str, list[np.ndarray]] = {}
    for r in sample(docs, TRAIN_DOCS, id_col, text_col, lang_col):
        if has_letter(r["text"].encode()):
            texts.setdefault(r["lang"], []).append(folded(r["text"].encode()))
    if not texts:
        return None
    langs, rng = sorted(texts), np.random.default_rng(13)
    joined = [np.concatenate(texts[lang]) for lang in langs]
    most = np.array([len(x) for x in joined])

    def draw() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        labels = rng.integers(0, len(langs), BATCH)
        lengths = np.minimum(rng.integers(SHORTEST, LONGEST + 1, BATCH), most[labels])
        order = np.argsort(-lengths, kind="stable")
        labels, lengths = labels[order], lengths[order]
        windows = np.zeros((BATCH, LONGEST), np.uint8)
        for k, (label, n) in enumerate(zip(labels.tolist(), lengths.tolist(), strict=True)):
            at = int(rng.integers(0, len(joined[label]) - n + 1))
            windows[k, :n] = joined[label][at : at + n]
        return windows, lengths, labels

    net = BiGru(len(langs))
    net.train(draw, STEPS, RATE)
    return langs, net


def label_texts(texts: list[bytes | None], langs: list[str], net: BiGru | None) -> list[tuple[str, float]]:
    """(language, score) of every whole text."""
    out: list[tuple[str, float]] = []
    if net is None:
        return [(UNKNOWN, 0.0)] * len(texts)
    for block in blocks(texts, BLOCK_BYTES):
        windows, lengths, text = windows_of(block)
        pooled = np.zeros((len(block), len(langs)))
        np.add.at(pooled, text, net.sums(windows, lengths))
        pooled /= np.maximum(pooled.sum(axis=1, keepdims=True), 1e-12)
        best, score = pooled.argmax(axis=1).tolist(), np.clip(pooled.max(axis=1), 0, 1).tolist()
        for text_, k, s in zip(block, best, score, strict=True):
            out.append((langs[k], s) if has_letter(text_) else (UNKNOWN, 0.0))
    return out


def identify(docs: DataFrame, model: tuple[list[str], BiGru] | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every whole text, by a fitted model."""
    langs, net = model or ([], None)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = label_texts(batch.column(1).to_pylist(), langs, net)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([name for name, _ in labels], pa.string()), pa.array([score for _, score in labels], pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.withColumn("held_out", fold(F.col("doc_id")) == HELD_OUT).mapInArrow(label, "doc_id long, held_out boolean, lang_pred string, score double")


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Return per document: doc_id, held_out, lang_pred, score.

    The model learns from labelled documents outside the held-out fold only.  A
    null text, or one without a letter, is ``und`` with score 0; so is every
    text if no labelled document has one.  A null id counts as the empty text in
    the fold.  Repeated rows each have their row; an empty table gives an empty
    result; further columns are ignored.
    """
    return identify(docs, fit(docs, id_col, text_col, lang_col), id_col, text_col)


def score_limit(docs: DataFrame, model: tuple[list[str], BiGru] | None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> float:
    """The score below which the stage rejects, from all labelled documents of the held-out fold, each read whole; the model was not trained on them.

    Scores fall as more languages are learned, so the limit follows the lowest score of a rightly
    named document.  Where none is rightly named, nothing is rejected by its score.
    """
    if model is None:
        return 0.0
    langs, net = model

    def lowest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = label_texts(batch.column(0).to_pylist(), langs, net)
            right = [score for (name, score), lang in zip(found, batch.column(1).to_pylist(), strict=True) if name == lang]
            yield pa.RecordBatch.from_arrays([pa.array([min(right, default=None)], pa.float64())], names=["score"])

    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"), F.col(lang_col).alias("lang"))
    judged = named.filter((fold(F.col("doc_id")) == HELD_OUT) & F.col("text").isNotNull() & F.col("lang").isNotNull())
    low = judged.select("text", "lang").mapInArrow(lowest, "score double").agg(F.min("score")).first()[0]
    return 0.0 if low is None else min(MOST_LIMIT, SHARE_OF_LOWEST * low)


def keep_identified(docs: DataFrame, least_score: float | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents, with all their columns, whose language is known and has a score of at least ``least_score``, by default :func:`score_limit`.

    The labels are computed beside the rows in one pass: nothing is shuffled or
    joined.  Null texts and texts without a letter go; where no document is
    labelled, only those.  Rows with a null id and repeated rows are judged by
    their own text.  An empty table gives an empty result.
    """
    model = fit(docs, id_col, text_col, lang_col)
    langs, net = model or ([], None)
    limit = score_limit(docs, model, id_col, text_col, lang_col) if least_score is None else least_score
    names = docs.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            verdicts = [name != UNKNOWN and score >= limit for name, score in label_texts(texts, langs, net)] if net else [has_letter(t or b"") for t in texts]
            yield pa.RecordBatch.from_arrays(batch.column(1).flatten(), names=names).filter(pa.array(verdicts, pa.bool_()))

    rows = docs.select(F.col(text_col).cast("binary").alias("text"), F.struct("*").alias("row"))
    return rows.mapInArrow(keep, docs.schema)
