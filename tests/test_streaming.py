"""Streams against the same computation in batch; every stream comes in several micro-batches."""

import json

import pytest
from pyspark.sql import functions as F

from rillflow.operators.sessions import seconds
from rillflow.streaming import queries
from rillflow.streaming.sessions import batch_sessions, event_stream, run_to_table
from rillflow.streaming.state import stream_buffer
from tests.oracle import SMALL


def test_stream_sessions_equal_batch_but_for_open_ones(spark):
    rows = {tuple(r) for r in queries.stream_event_sessions(spark, SMALL).collect()}
    batch = {tuple(r) for r in queries.in_micros(batch_sessions(spark, SMALL)).collect()}
    assert rows <= batch
    assert len(batch - rows) <= 5  # one open session per event type


def test_stream_selection_equals_batch(spark):
    from rillflow.operators.folds import q_frame_selection

    stream = {tuple(r) for r in queries.stream_frame_selection(spark, SMALL).select("key", "frame_id", "reason").collect()}
    batch = {tuple(r) for r in q_frame_selection(spark, SMALL).select("key", "frame_id", "reason").collect()}
    assert stream <= batch
    assert len(batch - stream) <= len({k for k, *_ in batch})  # what only the end of input selects


def test_first_rows_are_unique(spark):
    out = queries.stream_first_by_user(spark, SMALL)
    assert out.count() == out.select("user_id", "event_type").distinct().count()
    assert out.filter(F.col("user_id").isNull()).count() == 0


def test_a_restarted_stream_goes_on_where_it_stopped(spark, tmp_path):
    """Four stretches, then the fifth after a restart: each row once, and state from before the restart is there."""
    folder = queries.in_parts(spark, SMALL)
    parts = spark.read.parquet(folder).withColumn("part", F.expr("ntile(5) over (order by ts)"))
    arrived = f"{tmp_path}/arrived"

    def arrive(low, high):
        for k in range(low, high):
            parts.filter(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(arrived)

    def run():
        events = event_stream(spark, arrived).withColumn("at_sec", seconds(F.col("ts")))
        run_to_table(stream_buffer(events, "user_id", 40 * 86400.0), f"{tmp_path}/rows", f"{tmp_path}/checkpoint")
        return spark.read.parquet(f"{tmp_path}/rows")

    arrive(1, 5)
    before = run().count()
    arrive(5, 6)
    rows = run()
    assert rows.count() > before
    last = {r.source: r.n for r in rows.groupBy("source").agg(F.max("n_buffered").alias("n")).collect()}
    assert last == {str(r.user_id): r.n for r in parts.groupBy("user_id").agg(F.count("*").alias("n")).collect()}
    assert not any(json.dumps(k) == "null" for k in last)


def test_no_machine_local_folder_on_a_cluster(spark):
    from rillflow.plans.lineage import shared_dir

    class Named:
        def __init__(self, value):
            self.value = value

        def get(self, key, default):
            return self.value

    class Session:
        def __init__(self, master, folder):
            self.conf = Named(folder)
            self.sparkContext = type("C", (), {"master": master, "applicationId": "test-app"})()

    assert shared_dir(Session("spark://host:7077", "hdfs://x/y/")) == "hdfs://x/y"
    with pytest.raises(RuntimeError):
        shared_dir(Session("spark://host:7077", None))


def test_keys_share_state_rows_by_bucket(spark, tmp_path):
    """With three buckets a stream holds three state rows, and emits what it does with nearly one bucket a key; keys that are idle for an hour go in both."""
    from rillflow.operators.selection import SelectionParams
    from rillflow.streaming.registry import IDLE, stream_registry, with_rocksdb
    from rillflow.streaming.state import stream_selection

    folder = queries.in_parts(spark, SMALL)
    events = event_stream(spark, folder, files_per_trigger=queries.FILES).withColumn("at_sec", seconds(F.col("ts"))).withColumn("id", F.col("event_id"))
    frames = events.select("ts", F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("frame_id"), "at_sec", (F.col("value") / 50000).alias("ratio"), (F.col("event_id") % 10 / 10.0).alias("area"), (F.col("value") / 10000).alias("signature"))
    streams = {
        "buffer": lambda n: stream_buffer(events, "user_id", 86400.0, buckets=n),
        "selection": lambda n: stream_selection(frames, SelectionParams(), idle_sec=3600.0, buckets=n),
        "registry": lambda n: stream_registry(events, "user_id", "id", "at_sec", most=3, idle_sec=3600.0, buckets=n),
    }
    with with_rocksdb(spark):
        for name, stream in streams.items():
            rows = {}
            for n in (3, 100_003):
                place = f"{tmp_path}/{name}-{n}"
                query = stream(n).writeStream.outputMode("append").format("parquet").option("path", f"{place}/rows").option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start()
                query.awaitTermination()
                held = max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress)
                assert held <= 3 if n == 3 else held > 3
                rows[n] = sorted(tuple(r) for r in spark.read.parquet(f"{place}/rows").collect())
            assert rows[3] == rows[100_003]
            if name == "registry":
                assert any(change == IDLE for *_, change in rows[3])
