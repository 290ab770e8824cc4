"""Keyed state over streams: frame selection, the detection buffer, and trace tailing."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rillflow.operators.selection import OUT, FrameSelector, SelectionParams, SelectionState
from rillflow.plans.lineage import shared_dir

BUFFER_SEC = 90.0
#: Keys of a stream share so many calls and state rows a batch.
BUCKETS = 2048


def bucket_of(key: Column, buckets: int = BUCKETS) -> Column:
    """The bucket of a key.  A call of a state function costs milliseconds however few its rows are, so keys share calls; they share nothing else."""
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _keep(state: GroupState, kept: dict, now: int) -> None:
    """Store a bucket's keys, each with its due time first; the bucket wakes at the earliest."""
    if not kept:
        state.remove()
        return
    dues, values = zip(*kept.values(), strict=True)
    state.update((list(kept), list(dues), list(values)))
    state.setTimeoutTimestamp(max(now + 1, min(dues)))


def stream_selection(frames: DataFrame, params: SelectionParams | None = None, idle_sec: float = 600.0, lateness: str = "90 seconds", buckets: int = BUCKETS) -> DataFrame:
    """Frame selection over a stream of (key, ts, frame_id, at_sec, ratio, area, signature).

    Each key's machine is kept as state between batches, with those of its bucket; rows of a batch are taken
    in time order.  A key is finished and forgotten once the watermark is
    ``idle_sec`` past its last row, which bounds the number of open keys.
    """
    chosen = params or SelectionParams()
    columns = ["key", "frame_id", "at_sec", "net", "reason", "is_fallback"]

    def advance(bucket: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = {key: (due, stored) for key, due, stored in zip(*state.get, strict=True)} if state.exists else {}
        now, out, awake = state.getCurrentWatermarkMs(), [], {}
        load = lambda key: FrameSelector(chosen, SelectionState.load(json.loads(kept[key][1])) if key in kept else None)
        if not state.hasTimedOut:
            rows = pd.concat(list(batches)).sort_values(["at_sec", "frame_id"], kind="stable")
            known = lambda c: rows[c].astype(object).where(rows[c].notna(), None).tolist()
            for key, frame_id, at, ratio, area, signature in zip(known("key"), rows["frame_id"].tolist(), rows["at_sec"].tolist(), rows["ratio"].tolist(), known("area"), known("signature"), strict=True):
                machine = awake[key][0] if key in awake else load(key)
                awake[key] = machine, at
                out += [(str(key), *r) for r in machine.take(int(frame_id), at, ratio, area, signature)]
        for key in [k for k, (due, _) in kept.items() if due < now and k not in awake]:
            out += [(str(key), *r) for r in load(key).finish()]
            del kept[key]
        for key, (machine, at) in awake.items():
            kept[key] = max(now + 1, int((at + idle_sec) * 1000)), json.dumps(machine.s.dump())
        _keep(state, kept, now)
        if out:
            yield pd.DataFrame(out, columns=columns)

    dealt = frames.withWatermark("ts", lateness).withColumn("bucket", bucket_of(F.col("key"), buckets))
    return dealt.groupBy("bucket").applyInPandasWithState(advance, OUT, "keys array<string>, dues array<long>, stored array<string>", "append", GroupStateTimeout.EventTimeTimeout)


def stream_buffer(events: DataFrame, source: str, keep_sec: float = BUFFER_SEC, lateness: str = "90 seconds", buckets: int = BUCKETS) -> DataFrame:
    """Per source, the number of detections in the last ``keep_sec`` seconds at every batch, and the newest time.

    Old rows leave from the head only: an old row behind a newer head stays until
    the head moves on.  A batch's rows are taken in time order.  A source is
    forgotten once the watermark is ``keep_sec`` past its newest row, when nothing
    of it would be left.  Reads (source, ts, at_sec).  Sources are kept with those of their bucket.
    """

    def advance(bucket: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = {key: (due, times) for key, due, times in zip(*state.get, strict=True)} if state.exists else {}
        now, fresh = state.getCurrentWatermarkMs(), {}
        if not state.hasTimedOut:
            for batch in batches:
                for key, at in zip(batch["source"].astype(object).where(batch["source"].notna(), None).tolist(), batch["at_sec"].tolist(), strict=True):
                    fresh.setdefault(key, []).append(at)
        kept = {key: (due, times) for key, (due, times) in kept.items() if due >= now or key in fresh}
        out = []
        for key, added in fresh.items():
            times = [*(kept[key][1] if key in kept else []), *sorted(added)]
            newest = max(times)
            head = 0
            while head < len(times) and times[head] < newest - keep_sec:
                head += 1
            kept[key] = max(now + 1, int((newest + keep_sec) * 1000)), times[head:]
            out.append((key, len(times) - head, newest))
        _keep(state, kept, now)
        if out:
            yield pd.DataFrame(out, columns=["source", "n_buffered", "newest_sec"])

    dealt = events.withWatermark("ts", lateness).select(F.col(source).cast("string").alias("source"), "ts", "at_sec").withColumn("bucket", bucket_of(F.col("source"), buckets))
    return dealt.groupBy("bucket").applyInPandasWithState(advance, "source string, n_buffered long, newest_sec double", "keys array<string>, dues array<long>, times array<array<double>>", "append", GroupStateTimeout.EventTimeTimeout)


def tail_to(stream: DataFrame, sink: Callable[[DataFrame, int], None], name: str) -> None:
    """Hand every new micro-batch to ``sink`` once, with its number; the checkpoint in the shared folder is the cursor."""
    checkpoint = f"{shared_dir(stream.sparkSession)}/tail-{name}"
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
