"""Where models plug in: text embedding, pair scoring and the injection guard, as Arrow-batched functions.

A model is any callable on a list of inputs.  It is built once per worker from a
factory, called in batches, and retried with growing pauses.  The stubs are
deterministic and stand in where no model is given.
"""

from __future__ import annotations

import hashlib
import json
import math
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StringType

RETRIES = 2
PAUSE_SEC = 0.5
BATCH = 64


def with_retries(call: Callable, items: list, retries: int = RETRIES, pause: float = PAUSE_SEC):
    """Call a model; a failure is tried again after 0.5, 1, ... seconds, the last one is raised."""
    for attempt in range(retries + 1):
        try:
            return call(items)
        except Exception:
            if attempt == retries:
                raise
            time.sleep(pause * 2**attempt)
    raise AssertionError("unreachable")


def batches_of(items: list, n: int = BATCH) -> Iterator[list]:
    for at in range(0, len(items), n):
        yield items[at : at + n]


def stub_embedder(dimension: int = 16) -> Callable[[list[str]], list[list[float]]]:
    """Signed word hashing, normalised.  Where a text's words cancel each other, its last word alone counts, so only a text without words has a zero vector."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            vector = [0.0] * dimension
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=4).digest(), "little")
                at, sign = h % dimension, 1.0 if h & (1 << 20) else -1.0
                vector[at] += sign
            if text.split() and not any(vector):
                vector[at] = sign
            out.append(vector)
        return out

    return embed


def normalised(vector: list[float]) -> list[float]:
    """Unit length; a zero vector stays zero."""
    size = math.sqrt(sum(x * x for x in vector))
    return [x / size for x in vector] if size else list(vector)


def embedder(factory: Callable[[], Callable[[list[str]], list[list[float]]]] = stub_embedder):
    """text -> array<float>: blank and null texts have null, the others keep their places in the batch."""

    @F.pandas_udf(ArrayType(FloatType()))
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for texts in parts:
            out: list = [None] * len(texts)
            real = [k for k, t in enumerate(texts) if t and t.strip()]
            for chunk in batches_of(real):
                for k, vector in zip(chunk, with_retries(model, [texts.iloc[k] for k in chunk]), strict=True):
                    out[k] = normalised(vector)
            yield pd.Series(out)

    return embed


def pair_scorer(factory: Callable[[], Callable[[list[tuple[str, str]]], list[float]]]):
    """(query, text) -> score of a cross-encoder."""

    @F.pandas_udf(DoubleType())
    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = factory()
        for queries, texts in parts:
            pairs = list(zip(queries.fillna(""), texts.fillna(""), strict=True))
            yield pd.Series([s for chunk in batches_of(pairs) for s in with_retries(model, chunk)], dtype="float64")

    return score


def rerank(candidates: DataFrame, query: Column, text: Column, scorer, previous: str, k: int) -> DataFrame:
    """The ``k`` candidates by cross-encoder score; without a scorer their previous order stays."""
    if scorer is None:
        return candidates.orderBy(previous).limit(k)
    return candidates.withColumn("pair_score", scorer(query, text)).orderBy(F.desc("pair_score"), previous).limit(k)


def guard_model(factory: Callable[[], Callable[[list[str]], list[str]]]):
    """text -> the guard's raw reply; a model that fails gives null, which closes."""

    @F.pandas_udf(StringType())
    def ask(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for texts in parts:
            out: list[str | None] = []
            for chunk in batches_of(texts.fillna("").tolist()):
                try:
                    out += with_retries(model, chunk, pause=0.01)
                except Exception:  # noqa: BLE001 - fail closed, not the job
                    out += [None] * len(chunk)
            yield pd.Series(out, dtype="object")

    return ask


def guard_reply(raw: Column) -> Column:
    """(is_injection, confidence) of a raw reply; both null where it is not an object with a boolean and a share of 1."""
    parsed = F.from_json(raw, "is_injection boolean, confidence double")
    good = parsed["is_injection"].isNotNull() & parsed["confidence"].between(0, 1)
    return F.when(good, parsed)


def report_json(row: DataFrame, columns: list[str]) -> DataFrame:
    """The given columns as one JSON text, for a report sink; nulls are left out."""
    return row.select(F.to_json(F.struct(*columns)).alias("report_json"))


def reply_of(is_injection: bool, confidence: float) -> str:
    return json.dumps({"is_injection": is_injection, "confidence": confidence})
