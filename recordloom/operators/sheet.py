"""Form-by-year sheets: long form, yearly change, ratios and wide views.

A sheet arrives as rows ``(by, ord, form, line, description, cells)`` where ``cells`` is an array of
``(tax_year, raw)``; see `recordloom.sources.sheet_files`. The stored truth is the long table
``(by, tax_year, db_col, value)``, one row per owner, year and field; wide tables are views of it.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordloom.functions import fixed_values as V
from recordloom.functions.numbers import parse_value, pct_change, ratio_pct
from recordloom.functions.text import field_name, strip
from recordloom.operators.shared import saved

RATIO_NAMES = [name for name, *_ in V.RATIOS]


def year_columns(names: Sequence[str]) -> list[tuple[int, int]]:
    """``(position, year)`` of the headers that are four digits; of equal years the last one counts."""
    found = {}
    for position, name in enumerate(names):
        if re.fullmatch(r"\d{4}", name.strip()):
            found[int(name.strip())] = position
    return [(position, year) for year, position in sorted(found.items())]


def label_column(names: Sequence[str]) -> str | None:
    """The header that holds the descriptions."""
    for name in ("Description", "Year"):
        if name in names:
            return name
    return names[2] if len(names) > 2 else None


def sheet_rows(sheet: DataFrame, by: Sequence[str] = (), order: str = "ord") -> DataFrame:
    """A wide text sheet (``Form, Line, ..., yyyy, ...``) as rows with an array of cells."""
    names = [c for c in sheet.columns if c not in (*by, order)]
    if "Form" not in names or "Line" not in names:
        raise ValueError("the sheet needs the columns 'Form' and 'Line'")
    label = label_column(names)
    cells = [
        F.struct(F.lit(year).alias("tax_year"), F.col(f"`{names[at]}`").cast("string").alias("raw"))
        for at, year in year_columns(names)
    ]
    none = F.array().cast("array<struct<tax_year:int,raw:string>>")
    return sheet.select(
        *by,
        F.col(order).alias("ord"),
        F.col("Form").alias("form"),
        F.col("Line").alias("line"),
        (F.col(f"`{label}`") if label else F.lit("")).alias("description"),
        (F.array(*cells) if cells else none).alias("cells"),
    )


def _valid(rows: DataFrame) -> DataFrame:
    """Rows of a form line: form and line are there, and the form is not the note form ``0``."""
    form, line = (strip(F.coalesce(c, F.lit(""))) for c in ("form", "line"))
    return rows.withColumns({"form": form, "line": line}).filter("form <> '' and line <> '' and form <> '0'")


def sheet_fields(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by, db_col, description, form, line)``; of lines with the same name the last one counts."""
    named = _valid(rows).select(
        *by,
        field_name(F.col("form"), F.col("line")).alias("db_col"),
        F.struct(strip(F.coalesce("description", F.lit(""))).alias("description"), "form", "line").alias("_f"),
        "ord",
    )
    return named.groupBy(*by, "db_col").agg(F.max_by("_f", "ord").alias("_f")).select(*by, "db_col", "_f.*")


def field_collisions(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Names that more than one line of a sheet leads to, with how many."""
    named = _valid(rows).withColumn("db_col", field_name(F.col("form"), F.col("line")))
    return named.groupBy(*by, "db_col").agg(F.count("*").alias("n")).filter("n > 1")


def unpivot_sheet(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Long form ``(by, tax_year, db_col, value)``; of lines with the same name the last one counts."""
    # The outer form, as for the plain one Spark checks the array's size first and builds it twice.
    long = (
        _valid(rows)
        .select(*by, "ord", field_name(F.col("form"), F.col("line")).alias("db_col"), F.inline_outer("cells"))
        .filter("tax_year is not null")
    )
    # Numbers are aggregated by hashing; texts would be sorted first.
    values = long.select(*by, "tax_year", "db_col", "ord", parse_value(F.col("raw")).alias("value"))
    return values.groupBy(*by, "tax_year", "db_col").agg(F.max_by("value", "ord").alias("value"))


def _years(returns: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per owner and year with a map of its figures; a year has at most as many as fields.

    A row without field stands for a year without figures.
    """
    entries = F.collect_list(F.when(F.col("db_col").isNotNull(), F.struct("db_col", "value")))
    return returns.groupBy(*by, "tax_year").agg(F.map_from_entries(entries).alias("_figures"))


def yoy_change(returns: DataFrame, fields: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """``(by, tax_year, db_col, yoy_pct)``: change against the previous stored year of the owner.

    The whole previous year is looked up, not the previous row of the field: a field that the
    previous year lacks gives NULL. ``fields`` lists the fields to give for every year; without it
    each year gives the fields it has.
    """
    in_order = Window.partitionBy(*by).orderBy("tax_year")
    years = _years(returns, by).withColumn("_before", F.lag("_figures").over(in_order))
    names = F.map_keys("_figures") if fields is None else F.array(*map(F.lit, fields)).cast("array<string>")
    each = years.select(*by, "tax_year", "_figures", "_before", F.explode(names).alias("db_col"))
    change = pct_change(F.try_element_at("_figures", F.col("db_col")), F.try_element_at("_before", F.col("db_col")))
    return each.select(*by, "tax_year", "db_col", change.alias("yoy_pct"))


def derived_ratios(returns: DataFrame, by: Sequence[str] = (), ratios=V.RATIOS) -> DataFrame:
    """One row per stored year with the three ratios; a missing or zero denominator gives NULL."""

    def figure(name: str):
        return F.max(F.when(F.col("db_col") == name, F.col("value")))

    return returns.groupBy(*by, "tax_year").agg(
        *[ratio_pct(figure(top), figure(bottom)).alias(name) for name, top, bottom, _ in ratios]
    )


def _wide(long: DataFrame, keys: Sequence[str], column: str, values: Sequence, figure: str) -> DataFrame:
    """One row per key, one column per value of ``column``, in one aggregation.

    Spark's ``pivot`` groups by key and value first, so a task holds an entry per figure instead of one per row.
    """
    largest = [F.max(F.when(F.col(column) == F.lit(v), F.col(figure))).alias(str(v)) for v in values]
    return long.groupBy(*keys).agg(*largest) if largest else long.select(*keys).distinct()


def pivot_returns(returns: DataFrame, fields: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One row per year, one column per field."""
    return _wide(returns, [*by, "tax_year"], "db_col", fields, "value")


def pivot_yoy(yoy: DataFrame, fields: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One row per year, one column ``yoy_{field}_pct`` per field."""
    wide = _wide(yoy, [*by, "tax_year"], "db_col", fields, "yoy_pct")
    return wide.withColumnsRenamed({f: f"yoy_{f}_pct" for f in fields})


def analysis_table(returns: DataFrame, fields: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """The stored analysis: ratios and one change column per field, one row per year, in one pass."""
    operands = {name for _, top, bottom, _ in V.RATIOS for name in (top, bottom)}
    names = sorted({*fields, *operands})
    wide = returns.groupBy(*by, "tax_year").agg(
        *[F.max(F.when(F.col("db_col") == name, F.col("value"))).alias(name) for name in names]
    )
    in_order = Window.partitionBy(*by).orderBy("tax_year")
    before = wide.select("*", *[F.lag(name).over(in_order).alias(f"_before_{name}") for name in fields])
    return before.select(
        *by,
        "tax_year",
        *[ratio_pct(F.col(top), F.col(bottom)).alias(name) for name, top, bottom, _ in V.RATIOS],
        *[pct_change(F.col(f), F.col(f"_before_{f}")).alias(f"yoy_{f}_pct") for f in fields],
    )


def label_fields(figures: DataFrame, fields: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Figures with the form, line and description of their field.

    Fields common to all owners are few names, each with a large share of the rows. They are saved, so
    that their size is known and Spark sends them to the figures instead of shuffling by name.
    """
    shared = [c for c in by if c in fields.columns]
    return figures.join(fields if shared else saved(fields), [*shared, "db_col"])


def analysis_report(
    yoy: DataFrame, fields: DataFrame, years: Sequence[int], by: Sequence[str] = ()
) -> DataFrame:
    """Field by year grid of the changes, with labels ``[form:line] description``."""
    labelled = label_fields(yoy, fields, by)
    label = F.concat(F.lit("["), F.col("form"), F.lit(":"), F.col("line"), F.lit("] "), F.col("description"))
    return _wide(labelled.withColumn("label", label), [*by, "db_col", "label"], "tax_year", years, "yoy_pct")


def ratio_report(returns: DataFrame, years: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """Metric by year grid of the ratios, with their labels."""
    labels = {name: label for name, _, _, label in V.RATIOS}
    each = derived_ratios(returns, by).select(
        *by,
        "tax_year",
        F.inline(F.array(*[F.struct(F.lit(labels[n]).alias("metric"), F.col(n).alias("pct")) for n in RATIO_NAMES])),
    )
    return each.groupBy(*by, "metric").pivot("tax_year", list(years)).agg(F.max("pct"))
