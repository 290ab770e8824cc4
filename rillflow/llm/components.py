"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm.counted_join import join_counted
from rillflow.plans.lineage import discard, materialize

#: Rounds over few links run in few tasks, each with so many links; at least so many tasks.
ROWS_PER_TASK, LEAST_TASKS = 20_000, 8


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame, tasks: int) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node of its neighbourhood."""
    both = _both(edges)
    lows = materialize(both.groupBy("u").agg(F.min("v").alias("low"), F.count("*").alias("n")).select("u", F.least("u", "low").alias("low"), "n").coalesce(tasks), "lows")
    return join_counted(both.filter("v > u"), lows, ["u"]).select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()


def _small_star(edges: DataFrame, tasks: int) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest of them."""
    down = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).coalesce(tasks), "downward")
    lows = materialize(down.groupBy("u").agg(F.min("v").alias("low"), F.count("*").alias("n")).coalesce(tasks), "lows")
    moved = join_counted(down, lows, ["u"]).filter("v > low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.unionByName(lows.select("u", F.col("low").alias("v"))).distinct().coalesce(tasks)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v); a component is named by its smallest node.

    Self-links and null ends are ignored.  The rounds end when the links no
    longer change; every link then points at its component's smallest node.  They
    grow with the logarithm of the longest path; if ``rounds`` do not suffice, an
    error is raised.
    """
    now = materialize(edges.select("u", "v").filter("u is not null and v is not null and u != v").distinct(), "links")
    state = _state(now)
    for _ in range(rounds):
        if not state[0]:
            break
        last = now
        tasks = max(LEAST_TASKS, state[0] // ROWS_PER_TASK)
        now = materialize(_small_star(_large_star(last, tasks), tasks), "links")
        discard(last)
        before, state = state, _state(now)
        if state == before:
            break
    else:
        raise RuntimeError(f"components are not finished after {rounds} rounds")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
