"""Values that run along a key in time order, for keys of any number of rows.

A plain window over a key brings all its rows to one task.  Here a key's rows
are dealt out by time bucket, and a short table of one row per key and bucket
tells what lies before each bucket.  It enters the bucket as its first row, so
rows and table meet in one shuffle, without a join, and null keys are keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_SEC = 3600.0
CHUNK_ROWS = 50_000
_AHEAD_OF_ALL = -(1 << 62)


def _packed(rows: DataFrame, key: list[str], order: list[str], at: str, bucket_sec: float) -> tuple[DataFrame, list[str]]:
    """The rows as one column, with their key, bucket and place in the order, and the names of the key's columns.

    Rows of equal order are placed by a hash of their columns, so that a task that is run again places them alike.
    """
    keys = [f"key_{k}" for k in range(len(key))]
    bucket = F.coalesce(F.floor(F.col(at) / bucket_sec), F.lit(_AHEAD_OF_ALL))
    packed = rows.select(F.struct("*").alias("row"), *[F.col(c).alias(n) for c, n in zip(key, keys, strict=True)], bucket.alias("bucket"), F.struct(*[F.col(c) for c in order], F.xxhash64(*[c for c, kind in rows.dtypes if "map<" not in kind and kind != "variant"]).alias("tie")).alias("place"))
    return packed, keys


def carry_forward(rows: DataFrame, key: list[str], order: list[str], at: str, values: dict[str, Column], bucket_sec: float = BUCKET_SEC) -> DataFrame:
    """Add every entry of ``values`` as a column: its last non-null value up to and including the row, along the key.

    ``order`` begins with the time ``at`` in seconds; rows with a null time come
    first, rows of equal order in a fixed but arbitrary order.  Null keys are a key of their own.
    An empty table gives an empty result.
    """
    names = [f"value_{k}" for k in range(len(values))]
    marked = rows.select("*", *[x.alias(f"__{n}") for n, x in zip(names, values.values(), strict=True)])
    packed, keys = _packed(marked, key, order, at, bucket_sec)
    packed = packed.select("*", *[F.col(f"row.__{n}").alias(n) for n in names])
    along = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = packed.groupBy(*keys, "bucket").agg(*[F.max_by(n, F.when(F.col(n).isNotNull(), F.col("place"))).alias(n) for n in names])
    before = ends.select(*keys, "bucket", *[F.last(n, ignorenulls=True).over(along).alias(n) for n in names])
    inside = Window.partitionBy(*keys, "bucket").orderBy(F.col("row").isNotNull(), "place").rowsBetween(Window.unboundedPreceding, 0)
    both = packed.unionByName(before, allowMissingColumns=True).select("row", *[F.last(n, ignorenulls=True).over(inside).alias(n) for n in names])
    return both.filter(F.col("row").isNotNull()).select(*[f"row.`{c}`" for c in rows.columns], *[F.col(n).alias(c) for n, c in zip(names, values, strict=True)])


def over_history(rows: DataFrame, key: list[str], order: list[str], at: str, history: int, values: dict, bucket_sec: float = BUCKET_SEC, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add every entry of ``values``, a function from a window to a column: the window holds the row and the ``history - 1`` before it in its key.

    Rows are numbered along their key and dealt out in chunks of ``chunk_rows``;
    the last rows of a chunk are repeated ahead of the next one.  Order, null
    times and keys, and empty tables are as in :func:`carry_forward`.
    """
    if chunk_rows < history - 1:
        raise ValueError("a chunk must hold the rows that the next one looks back on")
    packed, keys = _packed(rows, key, order, at, bucket_sec)
    along = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ahead = packed.groupBy(*keys, "bucket").agg(F.count("*").alias("step")).select(*keys, "bucket", F.coalesce(F.sum("step").over(along), F.lit(0)).alias("step"))
    inside = Window.partitionBy(*keys, "bucket").orderBy(F.col("row").isNotNull(), "place").rowsBetween(Window.unboundedPreceding, 0)
    numbered = packed.withColumn("step", F.lit(1).cast("long")).unionByName(ahead, allowMissingColumns=True).select("row", *keys, (F.sum("step").over(inside) - 1).alias("number")).filter(F.col("row").isNotNull())
    own = F.floor(F.col("number") / chunk_rows)
    looked_back_on = F.col("number") % chunk_rows >= chunk_rows - (history - 1)
    dealt = numbered.withColumn("chunk", F.explode(F.when(looked_back_on, F.array(own, own + 1)).otherwise(F.array(own))))
    flat = dealt.select(*[F.col(f"row.`{c}`") for c in rows.columns], *[F.col(n).alias(f"__{n}") for n in keys], F.col("number").alias("__number"), F.col("chunk").alias("__chunk"))
    w = Window.partitionBy(*[f"__{n}" for n in keys], "__chunk").orderBy("__number").rowsBetween(-(history - 1), 0)
    return flat.select("*", *[x(w).alias(c) for c, x in values.items()]).filter(F.col("__chunk") == F.floor(F.col("__number") / chunk_rows)).select(*rows.columns, *values)
