"""Joins of many rows with a table of counted keys, where one key may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most keys that are ever broadcast, and the rows of one key that a task takes in any case.
MOST_HOT = 10_000
EASY_ROWS = 50_000


def join_counted(rows: DataFrame, keys: DataFrame, key: list[str], n: str = "n") -> DataFrame:
    """Inner join of ``rows`` with ``keys``, which has one row a key and in ``n`` how many of ``rows`` have it.

    A key with more than a ``MOST_HOT``-th of all rows is broadcast: there are at
    most ``MOST_HOT`` such keys whatever the input's size.  The other keys are
    shuffled, so no task gets more of one key than that share (or ``EASY_ROWS``).
    ``keys`` is read several times and should be a written table.
    """
    total = keys.agg(F.sum(n)).first()[0] or 0
    limit = max(EASY_ROWS, total // MOST_HOT)
    hot = keys.filter(F.col(n) > limit)
    if hot.isEmpty():
        return rows.join(keys.hint("merge"), key)
    rest = rows.join(F.broadcast(hot.select(*key)), key, "left_anti").join(keys.filter(F.col(n) <= limit).hint("merge"), key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def join_salted(rows: DataFrame, keys: DataFrame, key: list[str], n: str = "n") -> DataFrame:
    """The same join, reading ``rows`` once, for rows that are costly to compute.

    A key with more than a ``MOST_HOT``-th of all rows is dealt to as many parts as
    keep each within that share (or ``EASY_ROWS``); its row of ``keys`` is repeated
    for them.  Rows are dealt by their place, so equal rows part as well.  Only
    the numbers of parts of hot keys, at most ``MOST_HOT``, are broadcast.
    """
    total = keys.agg(F.sum(n)).first()[0] or 0
    limit = max(EASY_ROWS, total // MOST_HOT)
    hot = keys.filter(F.col(n) > limit)
    if hot.isEmpty():
        return rows.join(keys.hint("merge"), key)
    parts = F.when(F.col(n) > limit, F.ceil(F.col(n) / limit)).otherwise(F.lit(1)).cast("long")
    dealt = rows.join(F.broadcast(hot.select(*key, parts.alias("__parts"))), key, "left")
    dealt = dealt.withColumn("__part", F.pmod(F.monotonically_increasing_id(), F.coalesce("__parts", F.lit(1)))).drop("__parts")
    spread = keys.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    return dealt.join(spread.hint("merge"), [*key, "__part"]).drop("__part")
