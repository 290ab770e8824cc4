"""A bounded registry as the state of a stream: each key holds its newest rows, the oldest going first."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from rillflow.operators.overviews import REGISTRY_SIZE
from rillflow.streaming.state import BUCKETS, bucket_of

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ENTERED, LEFT, IDLE = "entered", "left", "idle"
OUT = "key string, id long, change string"


class BoundedRegistry(StatefulProcessor):
    """Keeps the newest (id, at) rows of each key of a bucket in list state, a list entry for each key; the rows of a batch enter in the order of time and id.

    What enters and what leaves for it are rows of the output.  Once the watermark is
    ``idle_sec`` past a key's newest row, the bucket's timer empties the key.  Of a key, no more
    than the rows of ``most`` entries and of one Arrow batch are held in memory.
    """

    def __init__(self, most: int, idle_sec: float) -> None:
        self.most, self.idle_ms = most, int(idle_sec * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "key string, ids array<long>, ats array<double>")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        held = self._load()
        fresh = set()
        for row in rows:
            own = held.setdefault(row.key, [])
            fresh.add(row.key)
            own.append((row.at, row.id))
            yield Row(key=row.key, id=row.id, change=ENTERED)
            if len(own) > 16 * self.most:
                yield from self._cut(held, row.key)
        for name in fresh:
            yield from self._cut(held, name)
        self._store(held)

    def _load(self) -> dict:
        return {name: list(zip(ats, ids, strict=True)) for name, ids, ats in self.held.get()}

    def _cut(self, held: dict, name: str | None) -> Iterator[Row]:
        own = sorted(held[name])
        held[name] = own[-self.most :]
        yield from (Row(key=name, id=id_, change=LEFT) for _, id_ in own[: -self.most])

    def _due(self, own: list[tuple]) -> int:
        return int(own[-1][0] * 1000) + self.idle_ms

    def _store(self, held: dict) -> None:
        """All keys of the bucket, and one timer for the first of them to be idle."""
        self.held.put([(name, [id_ for _, id_ in own], [at for at, _ in own]) for name, own in held.items()])
        for due in list(self.handle.listTimers()):
            self.handle.deleteTimer(due)
        self.handle.registerTimer(min(self._due(own) for own in held.values()))

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        held, due = self._load(), max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        for name in [k for k, own in held.items() if self._due(own) <= due]:
            yield from (Row(key=name, id=id_, change=IDLE) for _, id_ in held.pop(name))
        if held:
            self._store(held)
        else:
            self.held.clear()


def stream_registry(events: DataFrame, key: str, id_col: str, at: str, most: int = REGISTRY_SIZE, idle_sec: float = 86400.0, lateness: str = "90 seconds", buckets: int = BUCKETS) -> DataFrame:
    """(key, id, change): every row as it enters its key's registry, and as it leaves it, because newer ones came or the key was idle.

    Reads a stream with the event time ``ts``, and ``at`` in seconds.  Its state lives in RocksDB, which
    the session must name as its state store (see :func:`with_rocksdb`).
    """
    rows = events.withWatermark("ts", lateness).select(F.col(key).cast("string").alias("key"), F.col(id_col).alias("id"), F.col(at).cast("double").alias("at"), "ts")
    return rows.withColumn("bucket", bucket_of(F.col("key"), buckets)).groupBy("bucket").transformWithState(BoundedRegistry(most, idle_sec), StructType.fromDDL(OUT), "append", "eventTime")


class with_rocksdb:  # noqa: N801 - reads as a clause
    """Streams that start inside use RocksDB for their state; afterwards the session's setting is what it was."""

    def __init__(self, spark) -> None:
        self.spark = spark

    def __enter__(self) -> None:
        self.before = self.spark.conf.get(PROVIDER, None)
        self.spark.conf.set(PROVIDER, ROCKSDB)

    def __exit__(self, *_: object) -> None:
        if self.before is None:
            self.spark.conf.unset(PROVIDER)
        else:
            self.spark.conf.set(PROVIDER, self.before)


def registered(changes: DataFrame) -> DataFrame:
    """(key, id) that the registries hold after all ``changes``."""
    return changes.groupBy("key", "id").agg(F.count_if(F.col("change") == ENTERED).alias("__in"), F.count_if(F.col("change") != ENTERED).alias("__out")).filter("__in > __out").select("key", "id")
