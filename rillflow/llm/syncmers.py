"""Document fingerprints from closed syncmers.

A k-mer of the UTF-8 bytes is an anchor when the smallest of its inner s-mers
lies at one of its two edges.  Whether a k-mer is chosen depends on the k-mer
alone, so an edit elsewhere in the text never moves an anchor.  A text keeps every
distinct anchor that is the smallest of some ``WINDOW`` successive ones, so a fingerprint
grows with its text and two texts that share ``WINDOW`` successive anchors share
a kept one.  A window may stick out at either end of the text, so short and long texts
follow one rule; ``keep_all`` asks for another one, which keeps all anchors of texts
with at most so many.  Kept anchors are written with their first places, in text order.
Likeness does not depend on what is kept: it is the share of common anchors among
all distinct anchors of both texts and counts only matches whose order agrees.
A text without a closed syncmer has itself as its anchor, so its likeness is 1 to an
equal text and 0 to any other.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm.shingles import mix64, window_min

K = 16
S = 8
ANCHORS = 48
WINDOW = 8
TARGET_ROWS = 4_000
MAX_RANGES = 8_192
NULL_ID = -(1 << 63)
_PIECE = 1 << 18


def closed_syncmers(data: bytes, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Places and 64-bit hashes of all closed syncmers; a text without any, such as one of 1 to k - 1 bytes, has itself as its only anchor.

    ``s`` is 8 bytes, an s-mer being read as one little-endian word; ``k`` is at most 16,
    so that its first and last s-mer hold all its bytes.
    """
    n = len(data)
    places, hashes = [], []
    for at in range(0, n - k + 1, _PIECE):
        part = data[at : at + _PIECE + k - 1]
        words = np.ndarray(len(part) - s + 1, dtype="<u8", buffer=part, strides=(1,))
        inner = mix64(words + np.uint64(0x9E3779B97F4A7C15))
        low = window_min(inner, k - s + 1)
        chosen = np.flatnonzero((low == inner[: len(low)]) | (low == inner[k - s :]))
        places.append(chosen + at)
        hashes.append(mix64(inner[chosen] + mix64(inner[chosen + k - s]) * np.uint64(3)))
    if not any(map(len, places)):
        whole = int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little")
        return np.zeros(min(n, 1), np.int64), np.full(min(n, 1), whole, np.uint64)
    return np.concatenate(places), np.concatenate(hashes)


def anchors_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(first places, hashes) of all distinct anchors, by ascending hash; hashes are cut to 32 bits."""
    places, hashes = closed_syncmers(data)
    value, first = np.unique((hashes >> np.uint64(32)).astype(np.uint32), return_index=True)
    return places[first], value


def fingerprint(anchors: tuple[np.ndarray, np.ndarray], keep_all: int | None = ANCHORS) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the kept anchors, in text order: by one rule for every text if ``keep_all`` is None, else all of up to so many."""
    order = np.argsort(anchors[0], kind="stable")
    places, value = anchors[0][order], anchors[1][order]
    if keep_all is None:
        beside = np.full(WINDOW - 1, 1 << 32, np.uint64)  # above every hash
        low = window_min(np.concatenate([beside, value.astype(np.uint64), beside]), WINDOW)
        kept = np.zeros(len(value), bool)
        for k in range(WINDOW):
            kept |= low[k : k + len(value)] == value
        return places[kept], value[kept]
    if len(value) <= keep_all:
        return places, value
    low = window_min(value, WINDOW)
    kept = np.zeros(len(value), bool)
    for k in range(WINDOW):
        kept[k : k + len(low)] |= value[k : k + len(low)] == low
    return places[kept], value[kept]


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Share of common anchors among those of both, counting a longest run of matches in the same order; 1 for two empty texts (only they have no anchor)."""
    if not len(a[1]) and not len(b[1]):
        return 1.0
    common, in_a, in_b = np.intersect1d(a[1], b[1], assume_unique=True, return_indices=True)
    tails: list[int] = []
    for x in b[0][in_b][np.argsort(a[0][in_a])].tolist():
        at = bisect_left(tails, x)
        tails[at : at + 1] = [x]
    return len(tails) / (len(a[1]) + len(b[1]) - len(common))


def encode(print_: tuple[np.ndarray, np.ndarray]) -> str:
    """``hash@place`` in text order, comma-joined, hexadecimal."""
    return ",".join([f"{h:08x}@{p:x}" for p, h in zip(print_[0].tolist(), print_[1].tolist(), strict=True)])


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_next(docs: DataFrame, id_col: str, text_col: str, target_rows: int) -> DataFrame:
    """Documents dealt to ranges of ascending id and sorted; each range also gets the first document of the next one.

    Range limits and each range's first id, one number per range, are the only
    things that pass through the driver.
    """
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"))
    n, low = ids.agg(F.count("*"), F.min("doc_id")).first()
    n_ranges = min(MAX_RANGES, max(1, -(-n // target_rows)))
    cuts = sorted({float(x) for x in ids.approxQuantile("doc_id", [k / n_ranges for k in range(1, n_ranges)], 0.2 / n_ranges)}) if n_ranges > 1 and low is not None else []
    cuts = [x for x in cuts if x > low]

    def dealt(df: DataFrame) -> DataFrame:
        if not cuts:
            return df.withColumn("__range", F.lit(0))
        deal = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="__at", outputCol="__range")
        return deal.transform(df.withColumn("__at", F.coalesce("doc_id", F.lit(low)).cast("double"))).withColumn("__range", F.col("__range").cast("int"))

    # the ascending order has null ids first; they are in the lowest range
    firsts = sorted((r["__range"], r["doc_id"]) for r in dealt(ids).groupBy("__range").agg(F.min(F.coalesce("doc_id", F.lit(NULL_ID))).alias("doc_id")).collect())
    before = pa.table({"__first": [x for _, x in firsts], "__before": pa.array([firsts[k - 1][0] for k in range(len(firsts))], pa.int32())})
    rows = dealt(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    here = F.struct(F.col("__range").alias("at"), F.lit(False).alias("peek"))
    there = F.when(F.col("__before").isNotNull(), F.struct(F.col("__before").alias("at"), F.lit(True).alias("peek")))
    return (
        rows.join(docs.sparkSession.createDataFrame(before), F.coalesce("doc_id", F.lit(NULL_ID)) == F.col("__first"), "left")
        .withColumn("__to", F.explode(F.array_compact(F.array(here, there))))
        .select(F.col("__to.at").alias("range"), F.col("__to.peek").alias("peek"), "doc_id", "text")
        .repartition(4 * max(1, len(firsts)), "range")  # so many that ranges seldom share a task
        .sortWithinPartitions("range", "peek", F.col("doc_id").asc_nulls_first(), F.sha1("text"))
    )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_rows: int = TARGET_ROWS, keep_all: int | None = ANCHORS) -> DataFrame:
    """Return doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text replaces the last floor(n_chars / 2) code points by the first
    as many (or all) of the next document in ascending doc_id order, null ids
    first; the last document is followed by the first, a single document by
    itself.  Repeated ids are ordered by the text's digest.  A null text is an
    empty one.  An empty table gives an empty result; further columns are ignored.
    ``keep_all`` is that of :func:`fingerprint`; likeness does not depend on it.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *[(c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")], ("near_edited", pa.float64()), ("near_next", pa.float64())])
        held: tuple | None = None

        def row(current: tuple, following: tuple) -> tuple:
            _, doc_id, text, own = current
            half = len(text) // 2
            edited = (text[: len(text) - half] + following[2][:half]).encode()
            other = anchors_of(edited)
            return doc_id, len(text), hashlib.sha256(edited).hexdigest(), encode(fingerprint(own, keep_all)), encode(fingerprint(other, keep_all)), likeness(own, other), likeness(own, following[3])

        for batch in batches:
            out = []
            for range_, peek, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                text = text.as_py()
                current = (range_, doc_id, text, anchors_of(text.encode()))
                if held is not None and held[0] == range_:
                    out.append(row(held, current))
                held = None if peek else current
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return with_next(docs, id_col, text_col, target_rows).mapInArrow(compare, OUT)
