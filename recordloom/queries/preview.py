"""Preview operators over the tables as they are."""

from __future__ import annotations

from recordloom.sources.preview import parquet_head, parquet_row_count

QUERIES = {
    "parquet_head": lambda spark, folder: parquet_head(spark, f"{folder}/orders.parquet", 10, ["o_orderkey"]),
    "parquet_row_count": lambda spark, folder: parquet_row_count(spark, f"{folder}/lineitem.parquet"),
}

SQL = {
    "parquet_head": "select * from orders order by o_orderkey limit 10",
    "parquet_row_count": "select count(*) as n from lineitem",
}
