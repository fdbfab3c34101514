"""Bank CSVs of two layouts as one transactions table."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions import fixed_values as V
from recordloom.functions.numbers import parse_amount, parse_dollar
from recordloom.functions.text import first_filled, normalize_date, normalize_description, strip
from recordloom.sources.csv_files import InputFile, find_files, header_names, read_cells

TRANSACTIONS = (
    "ord long, owner string, date string, description string, normalized_description string, "
    "amount double, subtype string, category string, account_id string, source_file string"
)


def detect_layout(header: Column) -> Column:
    """Layout of a header line, NULL when unknown; further columns and letter case do not matter."""
    names = F.transform(F.split(strip(header), ",", -1), lambda name: F.lower(strip(name)))
    found = F.lit(None).cast("string")
    for layout, required in reversed(V.LAYOUT_REQUIRED.items()):
        missing = F.array_except(F.array(*map(F.lit, required)), names)
        found = F.when(F.size(missing) == 0, layout).otherwise(found)
    return found


def _transactions(cells: DataFrame, names: Sequence[str], layout: str) -> DataFrame:
    """Cells by position to the transactions table; of equal header names the last one counts."""
    at = {name: F.col(f"c{i}") for i, name in enumerate(names)}

    def value(what: str, default: str = "") -> Column:
        return first_filled(*[at[n] for n in V.LAYOUT_COLUMNS[layout][what] if n in at], default=default)

    if layout == "discover":
        amount = parse_dollar(value("credit", "0")) - parse_dollar(value("debit", "0"))
    else:
        amount = parse_amount(value("amount", "0"))
    description = value("description")
    return cells.select(
        "ord",
        "owner",
        normalize_date(value("date")).alias("date"),
        description.alias("description"),
        normalize_description(description).alias("normalized_description"),
        amount.alias("amount"),
        value("subtype").alias("subtype"),
        F.lit(V.CATEGORY).alias("category"),
        F.lit(layout).alias("account_id"),
        "source_file",
    )


def scan_ledger_a(spark: SparkSession, files: Sequence[InputFile], multi_line: bool = True) -> DataFrame:
    """Files of the layout with one signed amount column; they share one header."""
    return _transactions(read_cells(spark, files, multi_line), header_names(files[0].header), "wealthfront")


def scan_ledger_b(spark: SparkSession, files: Sequence[InputFile], multi_line: bool = True) -> DataFrame:
    """Files of the layout with debit and credit columns; they share one header."""
    return _transactions(read_cells(spark, files, multi_line), header_names(files[0].header), "discover")


@dataclass(frozen=True)
class LedgerScan:
    transactions: DataFrame
    rejected: DataFrame  # path, reason


def scan_ledgers(
    spark: SparkSession,
    paths: Sequence[str],
    owner_of: Callable[[str], str] | None = None,
    multi_line: bool = True,
) -> LedgerScan:
    """All files of known layout, in request order; the others are listed with the reason."""
    files = find_files(spark, paths, owner_of)
    rejected = [(f.path, "file not found") for f in files if f.uri is None]
    by_header: dict[str, list[InputFile]] = {}
    for file in files:
        if file.uri is not None:
            by_header.setdefault(file.header, []).append(file)
    parts = []
    if by_header:
        headers = spark.createDataFrame([(h,) for h in by_header], "header string")
        layouts = headers.select("header", detect_layout(F.col("header")).alias("layout")).collect()
        for header, layout in layouts:
            group = by_header[header]
            if layout is None:
                rejected += [(f.path, f"unrecognised header: {header}") for f in group]
            else:
                scan = scan_ledger_b if layout == "discover" else scan_ledger_a
                parts.append(scan(spark, group, multi_line))
    return LedgerScan(
        reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], TRANSACTIONS),
        spark.createDataFrame(rejected, "path string, reason string"),
    )
