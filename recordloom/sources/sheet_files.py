"""Form-by-year CSV sheets."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.operators.sheet import label_column, year_columns
from recordloom.sources.csv_files import InputFile, find_files, header_names, read_cells

SHEET_ROWS = (
    "filer string, ord long, form string, line string, description string, "
    "cells array<struct<tax_year:int,raw:string>>"
)


@dataclass(frozen=True)
class SheetScan:
    rows: DataFrame
    rejected: DataFrame  # path, reason
    years: DataFrame  # filer, sheet (position in the request), tax_year: the year columns of each sheet


def _rows(cells: DataFrame, names: Sequence[str]) -> DataFrame:
    at = {name: F.col(f"c{i}") for i, name in enumerate(names)}
    label = label_column(names)
    years = [
        F.struct(F.lit(year).alias("tax_year"), F.col(f"c{i}").alias("raw")) for i, year in year_columns(names)
    ]
    values = F.array(*years) if years else F.array().cast("array<struct<tax_year:int,raw:string>>")
    return cells.select(
        F.col("owner").alias("filer"),
        "ord",
        at["Form"].alias("form"),
        at["Line"].alias("line"),
        (at[label] if label else F.lit("")).alias("description"),
        values.alias("cells"),
    )


def scan_sheets(
    spark: SparkSession,
    paths: Sequence[str],
    filer_of: Callable[[str], str] | None = None,
    multi_line: bool = True,
) -> SheetScan:
    """Rows of all sheets; sheets without the columns ``Form`` and ``Line`` are listed as rejected."""
    files = find_files(spark, paths, filer_of or (lambda path: ""))
    rejected = [(f.path, "file not found") for f in files if f.uri is None]
    by_header: dict[str, list[InputFile]] = {}
    for file in files:
        if file.uri is not None:
            by_header.setdefault(file.header, []).append(file)
    parts, years = [], []
    for header, group in by_header.items():
        names = header_names(header)
        if "Form" in names and "Line" in names:
            parts.append(_rows(read_cells(spark, group, multi_line), names))
            years += [(f.owner, f.pos, year) for f in group for _, year in year_columns(names)]
        else:
            rejected += [(f.path, "needs the columns 'Form' and 'Line'") for f in group]
    rows = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], SHEET_ROWS)
    return SheetScan(
        rows,
        spark.createDataFrame(rejected, "path string, reason string"),
        spark.createDataFrame(years, "filer string, sheet long, tax_year int"),
    )
