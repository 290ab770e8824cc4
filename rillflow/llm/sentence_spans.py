"""Substring deduplication by sliding sentence spans.

A sentence ends after a word that ends in ``.``, ``!`` or ``?``, before a line
break and at the text's end.  Inside it a cut stands before every word whose hash
is the smallest of some ``WINDOW`` successive words, so long sentences are cut at
places that the words themselves choose: a passage is cut alike wherever it
stands, and no part has more than ``WINDOW`` words.  A run is ``RUN`` consecutive
sentences, lengthened until it has ``LEAST_WORDS`` words; every run is hashed and
joined globally.  Of a repeated run the first occurrence (smallest id, then place)
stays; a sentence covered by any other occurrence is removed.

A passage of ``6 * WINDOW + 3`` (51) words holds a whole run wherever it begins:
the cuts at least ``WINDOW + 3`` words inside it do not depend on its surroundings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm.counted_join import join_counted
from rillflow.llm.shingles import blocks, locate_words, mix64, power_tables, window_min
from rillflow.plans.lineage import materialize

RUN = 3
WINDOW = 8
LEAST_WORDS = 16
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True
_CLOSE = np.zeros(256, bool)
_CLOSE[list(b"\"')]}")] = True
_AT = np.uint64((1 << 40) - 1)


def _ranks(joined: np.ndarray, starts: np.ndarray, ends: np.ndarray, names: np.ndarray) -> np.ndarray:
    """The words' rank by MD5; equal words have equal ranks."""
    _, first, inverse = np.unique(names, return_index=True, return_inverse=True)
    data = joined.tobytes()
    digests = [hashlib.md5(data[a:b]).digest() for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
    order = {d: k for k, d in enumerate(sorted(digests))}
    return np.array([order[d] for d in digests], dtype=np.uint64)[inverse]


def _cuts(ranks: np.ndarray, opening: np.ndarray) -> np.ndarray:
    """Places of the smallest word (the last of equals) of every ``WINDOW`` successive words of one sentence."""
    n = len(ranks)
    if n < WINDOW:
        return np.empty(0, np.int64)
    low = window_min((ranks << np.uint64(40)) | (_AT - np.arange(n, dtype=np.uint64)), WINDOW)
    sentence = np.cumsum(opening)
    whole = sentence[: len(low)] == sentence[WINDOW - 1 :]
    return (_AT - (low[whole] & _AT)).astype(np.int64)


def sentences(block: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first byte of every sentence, (n, 2) names of the run beginning there, sentences of that run, where each document's sentences begin).

    Bytes are counted in the block with one separator after each document.  A
    run that would pass its document's end has 0 sentences.
    """
    joined, starts, ends, names, begins = locate_words(block)
    n = len(starts)
    if not n:
        return np.empty(0, np.int64), np.empty((0, 2), np.uint64), np.empty(0, np.int64), np.zeros(len(block) + 1, np.int64)
    last = ends - 1
    last = np.where(_CLOSE[joined[last]] & (last > starts), last - 1, last)
    lines = np.concatenate([[0], np.cumsum(joined == 10)])
    opening = np.ones(n, bool)
    opening[1:] = _STOP[joined[last[:-1]]] | (lines[starts[1:]] > lines[ends[:-1]])
    opening[begins[:-1][begins[:-1] < n]] = True
    opening[_cuts(_ranks(joined, starts, ends, names), opening)] = True
    first = np.flatnonzero(opening)  # first word of every sentence
    of_doc = np.searchsorted(first, begins)
    after = np.append(first, n)
    to = np.maximum(np.arange(len(first)) + RUN, np.searchsorted(after, first + LEAST_WORDS))
    inside = to <= np.repeat(of_doc[1:], np.diff(of_doc))
    until = after[np.minimum(to, len(first))]
    power, inverse = power_tables(n)
    runs = np.empty((len(first), 2), np.uint64)
    for k, words in enumerate((names, mix64(names + np.uint64(0x9E3779B97F4A7C15)))):
        running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * power[:n])])
        runs[:, k] = mix64((running[until] - running[first]) * inverse[first])
    return starts[first], runs, np.where(inside, to - np.arange(len(first)), 0), of_doc


def _documents(texts: list[bytes | None]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, sentence starts, run names, sentences of the runs) of every document."""
    for block in blocks(texts):
        starts, runs, sizes, of_doc = sentences(block)
        at = 0
        for k, text in enumerate(block):
            lo, hi = of_doc[k], of_doc[k + 1]
            yield text, starts[lo:hi] - at, runs[lo:hi], sizes[lo:hi]
            at += len(text) + 1


def _first_runs(runs: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of a document's distinct runs (the first of each), and of the runs that repeat an earlier one of it."""
    real = np.flatnonzero(sizes > 0)
    _, first = np.unique(runs[real, 0], return_index=True)
    again = np.ones(len(real), bool)
    again[first] = False
    return real[np.sort(first)], real[again]


ROW = ["none", "doc_id", "text_key"]
_HASHED = "none boolean, doc_id long, text_key binary, runs array<struct<a:long,b:long>>"
_TRIMMED = "none boolean, doc_id long, n_sentences long, n_removed long, removed string, text binary"


def remove_repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return per document: doc_id, n_sentences, n_removed, removed, text.

    ``removed`` lists the removed sentences as first-last (from 0), comma-joined;
    ``text`` is what is left.  A null text is an empty one.  A document is a row:
    its id and its text, so rows that repeat an id with another text are documents
    of their own, ordered by the MD5 of the text.  Rows repeated with one id and
    text are one document: none removes sentences of the other.  Null ids come
    last in the order of ids.  An empty table gives an empty result; further
    columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    doc_id = F.col(id_col).cast("long")
    rows = docs.select(doc_id.isNull().alias("none"), F.coalesce(doc_id, F.lit(0)).alias("doc_id"), F.unhex(F.md5(text)).alias("text_key"), text.cast("binary").alias("text"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, ends = [np.empty((0, 2), np.uint64)], [0]
            for _, _, runs, sizes in _documents(batch.column(3).to_pylist()):
                parts.append(runs[_first_runs(runs, sizes)[0]])
                ends.append(ends[-1] + len(parts[-1]))
            both = np.concatenate(parts).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], lists], names=[*ROW, "runs"])

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for places, (text, starts, runs, sizes) in zip(batch.column(4).to_pylist(), _documents(batch.column(3).to_pylist()), strict=True):
                first, again = _first_runs(runs, sizes)
                cover = np.zeros(len(starts) + 1, np.int64)
                hit = np.concatenate([again, first[np.array(places or [], dtype=np.int64)]])
                np.add.at(cover, hit, 1)
                np.add.at(cover, hit + sizes[hit], -1)
                gone = np.cumsum(cover)[:-1] > 0
                limits = np.append(starts, len(text))
                edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
                spans = list(zip(edges[0::2].tolist(), edges[1::2].tolist(), strict=True))
                kept, at = [], 0
                for lo, hi in spans:
                    kept.append(text[at : limits[lo]])
                    at = limits[hi]
                kept.append(text[at:])
                out.append((len(starts), int(gone.sum()), ",".join(f"{lo}-{hi - 1}" for lo, hi in spans), b"".join(kept)))
            n_sentences, n_removed, removed, left = zip(*out, strict=True) if out else ((), (), (), ())
            columns = [pa.array(n_sentences, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(removed, pa.string()), pa.array(left, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], names=["none", "doc_id", "n_sentences", "n_removed", "removed", "text"])

    lists = materialize(rows.mapInArrow(hashed, _HASHED), "runs")
    runs = lists.select(*ROW, F.posexplode("runs").alias("place", "run")).select(*ROW, "place", "run.a", "run.b")
    # a document lists each of its runs once, so a name counted twice is that of two documents or rows; half of the name suffices to find it
    shared = materialize(runs.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1"), "shared")
    met = materialize(join_counted(runs, shared, ["a"]).drop("n"), "met")
    row = F.struct(*ROW)
    first = materialize(met.groupBy("a", "b").agg(F.min(row).alias("first"), F.count("*").alias("n")), "first")
    hits = join_counted(met, first, ["a", "b"]).filter(row != F.col("first")).groupBy(*ROW).agg(F.collect_set("place").alias("places"))
    left = rows.join(hits.hint("merge"), ROW, "left").select(*ROW, "text", "places").mapInArrow(trimmed, _TRIMMED)
    return left.select(F.when(~F.col("none"), F.col("doc_id")).alias("doc_id"), "n_sentences", "n_removed", "removed", F.col("text").cast("string").alias("text"))
