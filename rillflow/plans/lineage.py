"""Cutting lineage with tables written to the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


@cache
def _own_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix="rillflow-checkpoints-")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only where a session on one machine leaves it unset (tests) a temporary folder
    is made, one for each application; on a cluster that is an error, as executors
    would write where nobody else can read.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"{CHECKPOINT_KEY} must name a folder that the whole cluster shares")
    return (named or _own_dir(spark.sparkContext.applicationId)).rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The result depends on those files alone, so a lost executor costs no more
    than the tasks that were reading them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete the files of a table that :func:`materialize` wrote, once nothing will read it again."""
    spark = table.sparkSession
    root = shared_dir(spark).split(":", 1)[-1].lstrip("/")
    for file in table.inputFiles():
        folder = file.rsplit("/", 1)[0]
        if root in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
            return
