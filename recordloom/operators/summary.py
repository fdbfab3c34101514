"""Annual income, spend, net and count of transactions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions.numbers import as_decimal, exact_sum


def _prepared(transactions: DataFrame, by: Sequence[str], keep: Sequence[str]) -> DataFrame:
    amount = F.col("amount")
    # The decimal form is made once per row here, not once per grouping set.
    return transactions.select(
        *by,
        F.substring("date", 1, 4).alias("year"),
        *keep,
        amount,
        as_decimal(amount).alias("_exact"),
    )


def _figures() -> list[Column]:
    amount, exact = F.col("amount"), F.col("_exact")

    def part(condition: Column) -> Column:
        return exact_sum(F.when(condition, amount).otherwise(0.0), F.when(condition, exact).otherwise(0))

    zero = F.lit(0.0)
    return [
        F.coalesce(part(amount > 0), zero).alias("total_income"),
        F.coalesce(part(amount < 0), zero).alias("total_spend"),
        F.coalesce(exact_sum(amount, exact), zero).alias("net"),
        F.count("*").alias("txn_count"),
    ]


def annual_total(transactions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    rows = _prepared(transactions, by, [])
    return rows.groupBy(*by, "year", F.lit("all").alias("group_value")).agg(*_figures())


def annual_by_description(transactions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    rows = _prepared(transactions, by, ["normalized_description"])
    return rows.groupBy(*by, "year", F.col("normalized_description").alias("group_value")).agg(*_figures())


def annual_by_source(transactions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    rows = _prepared(transactions, by, ["source_file"])
    return rows.groupBy(*by, "year", F.col("source_file").alias("group_value")).agg(*_figures())


def _sets(rows: DataFrame, by: Sequence[str], figures: Sequence[Column]) -> DataFrame:
    """The three summaries of rows with year, normalized_description and source_file in one pass."""
    base = [F.col(c) for c in by] + [F.col("year")]
    description, source = F.col("normalized_description"), F.col("source_file")
    summed = rows.groupingSets(
        [base, [*base, description], [*base, source]], *base, description, source
    ).agg(F.grouping_id().alias("_set"), *figures)
    # Bits of the id, from the left: by, year, description, source; a set bit is a column left out.
    which = F.col("_set")
    return summed.select(
        *by,
        "year",
        F.when(which == 3, "total").when(which == 1, "description").otherwise("source_file").alias("group_type"),
        F.when(which == 3, "all").when(which == 1, description).otherwise(source).alias("group_value"),
        "total_income",
        "total_spend",
        "net",
        "txn_count",
    )


def annual_summary(transactions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The three summaries in one table, told apart by ``group_type``, from one pass over the rows.

    Every set is aggregated inside the map tasks first, so a year, description or file with a large
    share of the rows reaches the shuffle as one partial row per task.
    """
    return _sets(_prepared(transactions, by, ["normalized_description", "source_file"]), by, _figures())


def partial_sums(transactions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by, year, normalized_description, source_file)`` with sums that can be added to those of other rows.

    ``summary_of_sums`` over the partial sums of several batches is the summary of all their rows.
    """
    amount, exact = F.col("amount"), F.col("_exact")

    def part(name: str, condition: Column | None) -> list[Column]:
        a = amount if condition is None else F.when(condition, amount).otherwise(0.0)
        e = exact if condition is None else F.when(condition, exact).otherwise(0)
        return [
            F.sum(e).alias(f"{name}_exact"),
            F.sum(a).alias(f"{name}_double"),
            (F.count(e) == F.count(a)).alias(f"{name}_fits"),
        ]

    rows = _prepared(transactions, by, ["normalized_description", "source_file"])
    return rows.groupBy(*by, "year", "normalized_description", "source_file").agg(
        *part("total_income", amount > 0), *part("total_spend", amount < 0), *part("net", None), F.count("*").alias("txn_count")
    )


def summary_of_sums(sums: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The annual summary from partial sums."""

    def total(name: str) -> Column:
        whole = F.when(F.bool_and(f"{name}_fits"), F.sum(f"{name}_exact").cast("double")).otherwise(F.sum(f"{name}_double"))
        return F.coalesce(whole, F.lit(0.0)).alias(name)

    return _sets(sums, by, [total("total_income"), total("total_spend"), total("net"), F.sum("txn_count").alias("txn_count")])
