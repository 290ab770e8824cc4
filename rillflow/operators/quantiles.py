"""Exact medians of keys of any number of rows by distributed rank selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.operators.ranges import running

#: The bracket around the median, as shares of a key's rows, and the accuracy of the sketch that finds it; the bracket is a hundred times as wide as its error.
AROUND = (0.49, 0.51)
ACCURACY = 10_000


def exact_medians(rows: DataFrame, key: list[str], value: str, name: str = "center", count: str = "n_points") -> DataFrame:
    """(key, median, number) of every key's non-null values; of an even number of values the mean of the middle two.

    A mergeable sketch of bounded size brackets each key's median.  Rows below the
    bracket are only counted; those inside are counted by value and ranked in
    ranges, so neither a key's rows nor its distinct values are held in one task.
    A key with nulls only has no row.
    """
    known = rows.select(*key, F.col(value).cast("double").alias("__v")).filter("__v is not null")
    sketch = known.groupBy(*key).agg(F.count("*").alias("__n"), F.percentile_approx("__v", list(AROUND), ACCURACY).alias("__around"))
    low, high = F.col("__around")[0], F.col("__around")[1]
    inside = known.join(sketch, key).filter(F.col("__v") <= high).select(*key, "__n", F.when(F.col("__v") >= low, F.col("__v")).alias("__v"))
    counts = inside.groupBy(*key, "__n", "__v").agg(F.count("*").alias("__m"))
    ranked = running(counts, key, [F.col("__v").asc_nulls_first()], {"__upto": (F.col("__m"), F.sum)})
    first, second = F.floor((F.col("__n") + 1) / 2), F.floor(F.col("__n") / 2) + 1
    missed = F.col("__v").isNull() & (F.col("__upto") >= first)
    at = lambda rank: F.min(F.when(F.col("__upto") >= rank, F.col("__v")))
    found = ranked.groupBy(*key, "__n").agg(at(first).alias("__a"), at(second).alias("__b"), F.coalesce(F.max(missed), F.lit(False)).alias("__missed"))
    median = F.when(F.col("__missed"), F.raise_error(F.lit("the sketch's bracket lies above the median")).cast("double")).otherwise((F.col("__a") + F.col("__b")) / 2)
    return found.select(*key, median.alias(name), F.col("__n").alias(count))
