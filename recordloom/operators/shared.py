"""Cutting lineage on the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a local one is made only on a local master without it."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    current = named or context.getCheckpointDir()
    if current is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        current = tempfile.mkdtemp(prefix="recordloom-")
        context.setCheckpointDir(current)
    return current


def saved(df: DataFrame) -> DataFrame:
    """The frame written as a table to the shared folder and read back.

    It is computed once, survives lost executors, and its real size is known to the joins after it.
    """
    path = f"{_folder(df.sparkSession)}/saved-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _folder(spark: SparkSession) -> str:
    """The folder of this application's saved tables."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, name: str) -> str:
    """A new place for files below the folder of this application."""
    return f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"


def clean(spark: SparkSession) -> None:
    """Deletes all tables saved by this application; results that still read them are lost."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(_folder(spark))
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
