"""Tables between the steps of a plan, in a folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, a session on one machine (tests) uses its warehouse folder; on a cluster it
    is an error, because a folder of one machine would lose rows without a word. What an application
    leaves there goes when its driver ends.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch"
    folder = f"{root.rstrip('/')}/tessella/{context.applicationId}"
    mine = context._jvm.org.apache.hadoop.fs.Path(folder)
    files = mine.getFileSystem(context._jsc.hadoopConfiguration())
    if not files.exists(mine):
        files.mkdirs(mine)
        files.deleteOnExit(mine)
    return f"{folder}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends at files that any executor can read."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes materialised tables that nothing will read again."""
    for t in tables:
        if path := getattr(t, "_scratch", None):
            context = t.sparkSession.sparkContext
            target = context._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)
