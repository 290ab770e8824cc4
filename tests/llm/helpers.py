"""Documents with every awkward case, and rows by id."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, **columns):
    """A documents table from (doc_id, text) pairs; other columns from functions of the position."""
    rows = [(i, t, columns.get("lang", lambda k: "en")(k), columns.get("source", lambda k: "s0")(k), len(t) if t is not None else None) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def awkward(spark, texts):
    """The same with clashing extra columns."""
    from pyspark.sql import functions as F

    df = documents(spark, texts)
    for name in ("kept", "run", "size", "text_key", "node", "rank", "length", "score", "range", "peek", "path", "name", "row", "own_id", "own_size", "times", "id", "none", "n", "key", "family", "bucket", "deal", "__name", "__copy"):
        df = df.withColumn(name, F.lit(None).cast("string"))
    return df
