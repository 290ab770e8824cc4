"""Running values and ranks within a key under any order, for keys of any number of rows.

A window over a key brings all its rows to one task.  Here the rows are dealt out
by ranges of (key, order) whose limits Spark samples from the rows themselves, so
a large key covers many ranges, and are written with the number of their range.  A short
table of one row for each key and range tells what lies ahead of each range in its
key; it enters the range as its first row, so no join is needed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillflow.plans.lineage import materialize


def running(rows: DataFrame, key: list[str], order: list[Column], values: dict[str, tuple[Column, Callable]], own: bool = True, ranges: int | None = None) -> DataFrame:
    """Add every entry of ``values``, (column, aggregate), aggregated over the rows of the key up to this one; without this one if not ``own``.

    The aggregate must give the same result however its rows are grouped, as sums,
    extremes and bit operations do.  Rows of equal order are placed by a hash of
    their columns; null keys are a key.  What no row contributes to is null.
    ``ranges`` is the number of tasks, by default that of the session's shuffles.
    An empty table gives an empty result.
    """
    n = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = {f"__value_{k}": (name, *pair) for k, (name, pair) in enumerate(values.items())}
    marked = rows.select(
        "*", *[column.alias(c) for c, (_, column, _) in held.items()],
        F.xxhash64(*[c for c, kind in rows.dtypes if "map<" not in kind and kind != "variant"]).alias("__tie"), F.lit(True).alias("__row"),
    )
    keys = [F.col(c) for c in key]
    dealt = materialize(marked.repartitionByRange(n, *keys, *order, F.col("__tie")).withColumn("__range", F.spark_partition_id()), "ranges")
    ahead = Window.partitionBy(*key).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    # a range begins in the middle of one key at most, so few of these rows have anything ahead
    before = dealt.groupBy(*key, "__range").agg(*[aggregate(c).alias(c) for c, (_, _, aggregate) in held.items()], F.min("__range").alias("__at"))
    before = before.select(*key, "__range", F.count("*").over(ahead).alias("__ahead"), *[aggregate(c).over(ahead).alias(c) for c, (_, _, aggregate) in held.items()]).filter("__ahead > 0").drop("__ahead")
    both = dealt.unionByName(before.withColumn("__row", F.lit(False)), allowMissingColumns=True)
    inside = Window.partitionBy(*key, "__range").orderBy("__row", *order, "__tie").rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    return both.select(*rows.columns, "__row", *[aggregate(c).over(inside).alias(name) for c, (name, _, aggregate) in held.items()]).filter("__row").drop("__row")


def ranked(rows: DataFrame, key: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Add the place of every row in its key, from 1."""
    return running(rows, key, order, {name: (F.lit(1).cast("long"), F.sum)})
