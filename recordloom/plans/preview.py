"""Preview of a Parquet table: schema, first rows, and a note when there are none."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from recordloom.functions.fixed_values import DEFAULT_PREVIEW_ROWS
from recordloom.sources.preview import parquet_head, parquet_row_count, parquet_schema


def preview(
    spark: SparkSession, path: str, n: int = DEFAULT_PREVIEW_ROWS
) -> tuple[DataFrame | None, DataFrame, str | None]:
    """``(schema, first rows, note)``; a schema that cannot be read is noted and the rows are tried."""
    schema, note = None, None
    try:
        schema = parquet_schema(spark, path)
    except PySparkException as error:
        note = f"could not read the schema: {error}"
    rows = parquet_head(spark, path, n)
    if n > 0 and rows.isEmpty():
        note = "the table has 0 rows" if parquet_row_count(spark, path).first().n == 0 else "0 rows read"
    return schema, rows, note
