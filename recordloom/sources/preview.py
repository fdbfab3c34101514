"""Schema, first rows and row count of Parquet tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from recordloom.functions.fixed_values import DEFAULT_PREVIEW_ROWS


def parquet_schema(spark: SparkSession, path: str) -> DataFrame:
    """``(pos, name, type, nullable)`` from the file footer; no rows are read."""
    fields = spark.read.parquet(path).schema.fields
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(fields)]
    return spark.createDataFrame(rows, "pos int, name string, type string, nullable boolean")


def parquet_head(
    spark: SparkSession, path: str, n: int = DEFAULT_PREVIEW_ROWS, order: Sequence[str] = ()
) -> DataFrame:
    """The first ``n`` rows; with ``order`` the first in that order, else in file order."""
    rows = spark.read.parquet(path)
    return (rows.orderBy(*order) if order else rows).limit(n)


def parquet_row_count(spark: SparkSession, path: str) -> DataFrame:
    """One row ``n``; no column is read."""
    return spark.read.parquet(path).groupBy().count().withColumnRenamed("count", "n")
