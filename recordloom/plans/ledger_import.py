"""Ledger import: files -> transactions table -> annual summary."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.operators.merge import merge_ignore, merge_ignore_keyed
from recordloom.operators.shared import saved
from recordloom.operators.summary import partial_sums, summary_of_sums
from recordloom.operators.transfers import cancel_transfers
from recordloom.sources.ledger_files import scan_ledgers
from recordloom.sources.tables import (
    APPENDED_BUCKETS,
    Keyed,
    append,
    mark,
    marked,
    read_appended,
    read_snapshot,
    unmark,
    write_snapshot,
)


def transactions_path(store: str) -> str:
    return f"{store}/transactions"


def sums_path(store: str) -> str:
    return f"{store}/sums"


def analysis_path(store: str) -> str:
    return f"{store}/analysis"


def _open_path(store: str) -> str:
    """There while an import is under way, and after one that broke off."""
    return f"{store}/import_under_way"


def import_batch(batch: DataFrame, store: str, by: Sequence[str] = (), buckets: int = APPENDED_BUCKETS) -> DataFrame:
    """Cancels transfers inside the batch, appends what is not stored yet and brings the summary up to date.

    Stored transactions are in Spark's buckets of a digest of their key, so the anti join shuffles the
    batch only. Beside them stand partial sums per year, description and file; an import adds those of
    its own rows, and the summary is made from them without reading the transactions.

    Returns one row ``parsed, cancelled, inserted, skipped, analysis_rows``. Importing a batch again,
    also after a run that broke off half-way, adds only what is missing; after such a run the sums are
    made anew from the transactions.
    """
    spark = batch.sparkSession
    broken = marked(spark, _open_path(store))
    kept = saved(cancel_transfers(batch, by))
    table = Keyed(spark, transactions_path(store), buckets)
    fresh = _fresh(kept, table, by)
    fresh = saved(fresh.withColumn("imported_at", F.current_timestamp()))
    older = table.exists and read_appended(spark, sums_path(store)) is None
    mark(spark, _open_path(store))
    table.append(fresh)
    if broken or older:
        rows = rebuild_table(spark, store, by)
    else:
        append(partial_sums(fresh, by), sums_path(store))
        rows = _write_analysis(read_appended(spark, sums_path(store)), store, by)
    unmark(spark, _open_path(store))

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count("*").alias("n")).withColumn("what", F.lit(name))

    counts = counted(batch, "parsed").unionByName(counted(kept, "kept")).unionByName(counted(fresh, "inserted"))

    def figure(name: str):
        return F.max(F.when(F.col("what") == name, F.col("n")))

    return counts.agg(
        figure("parsed").alias("parsed"),
        (figure("parsed") - figure("kept")).alias("cancelled"),
        figure("inserted").alias("inserted"),
        (figure("kept") - figure("inserted")).alias("skipped"),
        F.lit(rows).alias("analysis_rows"),
    )


def _fresh(kept: DataFrame, table: Keyed, by: Sequence[str]) -> DataFrame:
    """The rows of a batch that the table does not hold, with their key."""
    if not table.has_keys:
        return merge_ignore(kept, table.read(), by=by)
    return merge_ignore_keyed(kept, table.read(), by=by)


def _write_analysis(sums: DataFrame, store: str, by: Sequence[str]) -> int:
    summary = summary_of_sums(sums, by)
    target = write_snapshot(summary.withColumn("computed_at", F.current_timestamp()), analysis_path(store))
    return sums.sparkSession.read.parquet(target).count()


def rebuild_table(spark: SparkSession, store: str, by: Sequence[str] = ()) -> int:
    """Computes the sums and the summary of all stored transactions anew; returns the summary's row count."""
    stored = spark.read.parquet(transactions_path(store))
    partial_sums(stored, by).write.mode("overwrite").parquet(sums_path(store))
    return _write_analysis(read_appended(spark, sums_path(store)), store, by)


def read_analysis(spark: SparkSession, store: str) -> DataFrame | None:
    return read_snapshot(spark, analysis_path(store))


def file_counts(batch: DataFrame, rejected: DataFrame) -> DataFrame:
    """Parsed rows per file, and the rejected files with their reason."""
    parsed = batch.groupBy("source_file").agg(F.count("*").alias("parsed"))
    refused = rejected.select(F.col("path").alias("source_file"), "reason")
    return parsed.unionByName(refused, allowMissingColumns=True)


def import_ledgers(
    spark: SparkSession,
    paths: Sequence[str],
    store: str,
    owner_of: Callable[[str], str] | None = None,
    multi_line: bool = True,
) -> tuple[DataFrame | None, DataFrame]:
    """Imports CSV files into a store; returns the counts (None without any row) and the file report.

    With ``multi_line=False``, for files without line breaks in cells, large files are read in pieces.
    """
    scan = scan_ledgers(spark, paths, owner_of, multi_line)
    batch = saved(scan.transactions)  # the files are parsed once
    report = file_counts(batch, scan.rejected)
    if batch.isEmpty():
        return None, report
    by = ["owner"] if owner_of else []
    return import_batch(batch, store, by), report
