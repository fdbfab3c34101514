"""Sheet import and multi-year analysis."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordloom.operators.merge import merge_replace
from recordloom.operators.shared import saved
from recordloom.operators.sheet import analysis_table, pivot_returns, sheet_fields, unpivot_sheet
from recordloom.sources.csv_files import sheet_of_row
from recordloom.sources.sheet_files import SheetScan, scan_sheets
from recordloom.sources.tables import read_snapshot, replace_in_buckets, write_snapshot

BY = ["filer"]


def returns_path(store: str) -> str:
    return f"{store}/tax_returns"


def analysis_path(store: str) -> str:
    return f"{store}/tax_return_analysis"


def field_list(rows: DataFrame) -> list[str]:
    """Names of the fields: one per line of the forms, so few."""
    return [r.db_col for r in sheet_fields(rows).select("db_col").distinct().orderBy("db_col").collect()]


def import_sheets(
    spark: SparkSession,
    paths: Sequence[str],
    store: str,
    filer_of: Callable[[str], str] | None = None,
    multi_line: bool = True,
) -> DataFrame:
    """Imports sheets; the years they have replace the stored years of their filer. Returns the rejected.

    One job imports all: of several sheets of a filer the last one in ``paths`` that has a year counts
    for that year. Only the buckets of the filers at hand are read and written. A year of a sheet without
    any usable line is stored too, as a row without field: it replaces the year and stands before the next.
    """
    scan = scan_sheets(spark, paths, filer_of, multi_line)
    new = saved(_last_sheets(scan, multi_line).withColumn("imported_at", F.current_timestamp()))
    if not new.isEmpty():
        replace_in_buckets(new, returns_path(store), ["tax_year"], BY)
    return scan.rejected


def _last_sheets(scan: SheetScan, multi_line: bool) -> DataFrame:
    """``(filer, tax_year, db_col, value)`` of the last sheet that has the year of the filer."""
    rows = scan.rows.withColumn("sheet", sheet_of_row(F.col("ord"), multi_line))
    figures = unpivot_sheet(rows, [*BY, "sheet"])
    no_figure = F.lit(None).cast("string").alias("db_col"), F.lit(None).cast("double").alias("value")
    years = scan.years.select(*BY, "sheet", "tax_year", *no_figure)
    year = Window.partitionBy(*BY, "tax_year")
    both = figures.unionByName(years).withColumn("_last", F.max("sheet").over(year)).filter("sheet = _last")
    some = F.count("db_col").over(year)
    return both.withColumn("_some", some).filter("db_col is not null or _some = 0").select(*BY, "tax_year", "db_col", "value")


def all_returns(spark: SparkSession, store: str, fields: Sequence[str]) -> DataFrame | None:
    """Wide view of the stored returns in the order of the years; None when nothing is stored."""
    stored = read_snapshot(spark, returns_path(store))
    return None if stored is None else pivot_returns(stored, fields, BY).orderBy(*BY, "tax_year")


def analyze(
    spark: SparkSession, paths: Sequence[str], store: str, filer_of: Callable[[str], str] | None = None
) -> DataFrame | None:
    """Computes and stores the analysis for the fields of the given sheets; None when nothing is stored."""
    stored = read_snapshot(spark, returns_path(store))
    if stored is None:
        return None
    fields = field_list(scan_sheets(spark, paths, filer_of).rows)
    new = saved(analysis_table(stored, fields, BY).withColumn("computed_at", F.current_timestamp()))
    write_snapshot(merge_replace(read_snapshot(spark, analysis_path(store)), new, by=BY), analysis_path(store))
    return new
