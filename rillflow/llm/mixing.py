"""Mixing sources to target weights with exact word budgets.

Every document gets a hash-random key.  Within its source, documents are
range-sorted by that key (the key's leading digits name the range), distributed
prefix sums of the word counts are taken (totals of the ranges before, plus a
running sum inside the range), and the mix is cut where the source's budget is
used up.  A budget above the source's size repeats the source in whole epochs
first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillflow.plans.lineage import materialize

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"
ROWS_PER_RANGE = 500
MAX_DIGITS = 6


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))).cast("long")


def _in_ranges(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """The rows range-sorted by ``order`` and written, each with the number of its range."""
    return materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id()), name)


def _sums_ahead(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds prefix sums over all rows before each one: totals of the ranges ahead (one row a range), plus a running sum inside the range."""
    ahead = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("range").agg(*[F.sum(x).alias(c) for c, x in sums.items()])
    totals = totals.select("range", *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"{c}_ranges") for c in sums])
    running = rows.select("*", *[F.coalesce(F.sum(x).over(inside), F.lit(0)).alias(c) for c, x in sums.items()])
    return running.join(totals, "range").select(*rows.columns, *[(F.col(c) + F.col(f"{c}_ranges")).alias(c) for c in sums]).drop("range")


def targets(sized: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """Per source: its size and its share of all words, by weight, with the excess over ``max_epochs`` times its size reshared.

    Sources in ascending order of size per weight reach their limit first, so
    the common share per weight is found with prefix sums over the sources.  Both
    orders are range-sorted, so no task holds all sources; three numbers of the
    first source below its limit pass through the driver.
    """
    by_name = [F.col("source").asc_nulls_last()]
    named = _in_ranges(sized.groupBy("source").agg(F.sum("size").alias("source_size")), by_name, "sources")
    weighed = (
        _sums_ahead(named, by_name, {"place": F.lit(1)})
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("place"), F.lit(len(weights))) + 1).cast("int")).cast("long"))
        .withColumn("most", F.col("source_size") * max_epochs)
        .withColumn("ratio", F.col("source_size") / F.col("weight"))
    )
    by_ratio = [F.col("ratio").asc(), F.col("place").asc()]
    ordered = _in_ranges(weighed, by_ratio, "source-ratios")
    words, weight = ordered.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    shared = _sums_ahead(ordered, by_ratio, {"most_ahead": F.col("most"), "weight_ahead": F.col("weight")}).withColumn(
        "share", (F.lit(words) - F.col("most_ahead")).cast("double") / (F.lit(weight) - F.col("weight_ahead")).cast("double")
    )
    first = shared.filter(F.col("share") * F.col("weight") < F.col("most")).orderBy(*by_ratio).select("ratio", "place", "share").first()
    target = F.col("most").cast("double")
    if first is not None:
        before = (F.col("ratio") < first["ratio"]) | ((F.col("ratio") == first["ratio"]) & (F.col("place") < first["place"]))
        target = F.when(before, target).otherwise(F.lit(first["share"]) * F.col("weight"))
    return shared.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: str = SEED,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Return per document: doc_id, size, source_size, target, taken, mix_key.

    ``taken`` counts the words the mix takes, repeats included: whole epochs of
    the source, then documents in key order until the budget is used up; the
    document at the cut is taken in part.  A null text has size 0, a null source
    is a source of its own (the last one); rows with a null id have keys by their text, so
    that many of them are many keys.  Repeated rows
    are documents of their own.  An empty table gives an empty result; further
    columns are ignored.
    """
    sized = materialize(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            word_count(F.col(text_col)).alias("size"),
            F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit(":"), F.md5(F.coalesce(F.col(text_col), F.lit(""))))))).alias("mix_key"),
        ),
        "sizes",
    )
    digits, n_rows = 1, sized.count()
    while 16**digits * rows_per_range < n_rows and digits < MAX_DIGITS:
        digits += 1
    sized = sized.withColumn("range", F.substring("mix_key", 1, digits)).withColumn("group", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    w = Window.partitionBy("group").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (
        sized.groupBy("group", "range").agg(F.sum("size").alias("words"))
        .withColumn("ahead", F.coalesce(F.sum("words").over(w), F.lit(0)))
        .join(targets(sized, weights, max_epochs).withColumn("group", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).drop("source"), "group")
        .drop("words")
    )
    inside = Window.partitionBy("group", "range").orderBy("mix_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    return (
        sized.join(ranges, ["group", "range"])
        .withColumn("before", F.col("ahead") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .withColumn("epochs", epochs)
        .withColumn("budget", F.floor(F.col("target") - F.col("epochs") * F.col("source_size") + 0.5))
        .select(
            "doc_id",
            "size",
            "source_size",
            "target",
            (F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - F.col("before")))).cast("long").alias("taken"),
            "mix_key",
        )
    )


def draw_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix as whole documents, with all their columns: each as many times as its source's epochs take it.

    The document at the cut is drawn once more if at least half of it fits the
    budget.  A document without words is drawn once.  Rows with a null id are
    drawn like the others; rows repeated with one id and size are each drawn as
    often as the one of them that is drawn most.  A null text has no words.  An
    empty table gives an empty result.
    """
    drawn = mix(docs, id_col, text_col, source_col, **options).select(
        F.col("doc_id").alias("id"), "size", F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(1).cast("int").alias("times")
    )
    times = drawn.groupBy("id", "size").agg(F.max("times").alias("times"))
    sized = docs.select(F.col(id_col).cast("long").alias("own_id"), word_count(F.col(text_col)).alias("own_size"), F.struct("*").alias("row"))
    return (
        sized.join(times.filter("times > 0"), F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_size") == F.col("size")))
        .select("row", F.explode(F.sequence(F.lit(1), "times")))
        .select("row.*")
    )
