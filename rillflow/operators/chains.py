"""Chains along a key: each stop is the first row beyond a limit that the stop before it sets.

Such a chain looks sequential, as every stop depends on the one before.  Here every
row's next stop is found first, for all rows at once, by sorting values and limits
together; the pointers are then doubled, so a chain of n stops takes as many rounds as n has binary digits.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.operators.along import over_history
from rillflow.operators.ranges import running
from rillflow.plans.lineage import materialize

_NO_KEY = object()


def _same(a: str, b: str, at: str) -> Column:
    return F.col(f"{a}.key").eqNullSafe(F.col(f"{b}.key")) & (F.col(f"{a}.{at}") == F.col(f"{b}.row"))


def chain_starts(placed: DataFrame, key: str, at: str, reach: Column, limit: Column, at_limit: bool = False) -> DataFrame:
    """(key, row, no): the stops of each key's chain, from its first row on, numbered from 0.

    Its tables grow with the rows, so they are merged, never broadcast through the driver.  ``at`` numbers a key's rows from 1 and ``reach`` never falls along them.  From a row
    the chain goes to the first one whose reach is beyond the row's ``limit``, or at it if
    ``at_limit``; the row itself must not be.  Null keys are a key.
    """
    ends = placed.select(F.col(key).alias("key"), reach.alias("reach"), F.lit(0 if at_limit else 1).alias("kind"), F.col(at).alias("at"), F.col(at).alias("row"))
    limits = placed.select(F.col(key).alias("key"), limit.alias("reach"), F.lit(1 if at_limit else 0).alias("kind"), F.lit(None).cast("long").alias("at"), F.col(at).alias("row"))
    beyond = running(ends.unionByName(limits), ["key"], [F.col("reach").desc(), F.col("kind").asc()], {"to": (F.col("at"), F.min)})
    jumps = materialize(beyond.filter((F.col("kind") == (1 if at_limit else 0)) & F.col("to").isNotNull()).select("key", "row", "to"), "jumps")
    starts = materialize(placed.filter(F.col(at) == 1).select(F.col(key).alias("key"), F.col(at).alias("row"), F.lit(0).alias("no")), "starts")
    step = 1
    while not jumps.isEmpty():
        # starts holds the first ``step`` stops of each key, jumps go ``step`` stops ahead
        a, b, c = starts.alias("a"), jumps.alias("b"), jumps.alias("c")
        ahead = a.join(b.hint("merge"), _same("a", "b", "row")).select("a.key", F.col("b.to").alias("row"), (F.col("a.no") + step).alias("no"))
        starts = materialize(starts.unionByName(ahead), "starts")
        jumps = materialize(c.join(b.hint("merge"), _same("c", "b", "to")).select("c.key", "c.row", "b.to"), "jumps")
        step *= 2
    return starts


def with_starts(placed: DataFrame, starts: DataFrame, key: str, at: str, name: str) -> DataFrame:
    """The rows with the number of the stop that they are, null for others, as ``name``."""
    named = starts.select(F.col("key").alias("__key"), F.col("row").alias("__row_no"), F.col("no").alias(name))
    return placed.join(named.hint("merge"), F.col(key).eqNullSafe(F.col("__key")) & (F.col(at) == F.col("__row_no")), "left").drop("__key", "__row_no")


def without_near_repeats(rows: DataFrame, key: str, order: list[str], signature: str, least: float) -> DataFrame:
    """The rows whose signature differs by at least ``least`` from that of the last row kept before them in their key.

    Which row is compared depends on all decisions before, and values go up and down, so no
    window finds it.  Spark deals the keys out and sorts them; a task then reads its rows in order and
    holds one number.  A null signature is near nothing: its row is kept and nothing is
    compared with it.  Rows of equal order are placed by a hash of their columns; null keys are a key.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last = _NO_KEY, None
        for batch in batches:
            kept = []
            for name, mark in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name != own:
                    own, last = name, None
                fresh = mark is None or last is None or abs(mark - last) >= least
                if fresh:
                    last = mark
                kept.append(fresh)
            yield pa.RecordBatch.from_arrays(batch.column(2).filter(pa.array(kept, pa.bool_())).flatten(), names=names)

    names = rows.columns
    marked = rows.select(F.col(key).alias("__key"), F.col(signature).cast("double").alias("__mark"), F.struct(*names).alias("__row"), *[F.col(c).alias(f"__order_{k}") for k, c in enumerate(order)], F.xxhash64(*names).alias("__tie"))
    dealt = marked.repartition("__key").sortWithinPartitions("__key", *[f"__order_{k}" for k in range(len(order))], "__tie")
    return dealt.select("__key", "__mark", "__row").mapInArrow(scan, rows.schema)


def rising_change(rows: DataFrame, key: str, at: str, tie: str, signature: str, interval: float, early: float, keep: int = 30) -> DataFrame:
    """Add ``change`` against a reference row that is renewed every ``interval`` seconds, ``net`` of its noise, and ``rising``.

    The first row is the first reference; a row at least ``interval`` after the reference is
    still compared with it and then takes its place.  Noise is the median of the last ``keep``
    changes found at renewals.  A row rises if its net change is at least
    ``early`` and above that of the row before it, counted from 0 after each renewal.  Rows
    with a null signature are compared with nothing and do not rise.
    """
    if interval <= 0:
        raise ValueError("the interval must be positive")
    known = rows.filter(F.col(signature).isNotNull())
    placed = materialize(running(known, [key], [F.col(at).asc(), F.col(tie).asc()], {"__at": (F.lit(1).cast("long"), F.sum)}), "placed")
    marked = with_starts(placed, chain_starts(placed, key, "__at", F.col(at).cast("double"), F.col(at) + F.lit(interval), at_limit=True), key, "__at", "__ref")
    reference = F.when(F.col("__ref").isNotNull(), F.struct(F.col("__at").alias("at"), F.col("__ref").alias("no"), F.col(signature).alias("signature")))
    seen = running(marked, [key], [F.col("__at").asc()], {"__last": (reference, F.max)}, own=False)
    seen = materialize(seen.withColumn("change", F.abs(F.col(signature) - F.col("__last.signature"))), "changes")
    renewed = seen.filter("__ref is not null and change is not null").select(F.col(key).alias("key"), F.col("__at").alias("at"), F.col("__ref").alias("no"), "change")
    floors = over_history(renewed, ["key"], ["at"], "at", keep, {"floor": lambda w: F.percentile("change", F.lit(0.5)).over(w)})
    floors = floors.select(F.col("key").alias("__key"), F.col("no").alias("__no"), "floor")
    floored = seen.join(floors.hint("merge"), F.col(key).eqNullSafe(F.col("__key")) & (F.col("__last.no") == F.col("__no")), "left").drop("__key", "__no")
    net = materialize(floored.withColumn("net", F.greatest(F.lit(0.0), F.col("change") - F.coalesce("floor", F.lit(0.0)))), "net-changes")
    before = net.select(F.col(key).alias("__key"), (F.col("__at") + 1).alias("__next"), F.col("__last.no").alias("__no"), F.col("net").alias("__before"))
    both = net.join(before.hint("merge"), F.col(key).eqNullSafe(F.col("__key")) & (F.col("__at") == F.col("__next")), "left")
    previous = F.when(F.col("__no") == F.col("__last.no"), F.col("__before")).otherwise(0.0)
    rising = F.coalesce((F.col("net") >= early) & (F.col("net") > F.coalesce(previous, F.lit(0.0))), F.lit(False))
    found = both.select(*rows.columns, "change", F.when(F.col("change").isNotNull(), F.col("net")).alias("net"), rising.alias("rising"))
    return found.unionByName(rows.filter(F.col(signature).isNull()).withColumn("rising", F.lit(False)), allowMissingColumns=True)
