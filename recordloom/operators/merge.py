"""Import without duplicates, and whole-row replacement."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRANSACTION_KEY = ("date", "description", "amount", "account_id")


def first_rows(
    batch: DataFrame,
    key: Sequence[str] = TRANSACTION_KEY,
    order: str = "ord",
    required: Sequence[str] = ("date", "description", "amount"),
    by: Sequence[str] = (),
) -> DataFrame:
    """The first row of every key, in the order of ``order``; rows lacking a required value are left out.

    As in a SQL unique constraint, a NULL in an optional key column equals nothing, so such rows all
    stay. ``row_number() = 1`` is trimmed inside every map task before the shuffle, so a key that
    holds a large share of the rows sends at most one row per task.
    """
    rows = batch.dropna(subset=list(required)) if required else batch
    optional = [c for c in key if c not in required]
    parts = [*by, *key]
    if optional:
        incomplete = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in optional])
        parts.append(F.when(incomplete, F.col(order)))
    first = Window.partitionBy(*parts).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def merge_ignore(
    batch: DataFrame,
    stored: DataFrame | None,
    key: Sequence[str] = TRANSACTION_KEY,
    order: str = "ord",
    required: Sequence[str] = ("date", "description", "amount"),
    by: Sequence[str] = (),
) -> DataFrame:
    """Rows of the batch to append: first of their key in the batch and not stored yet.

    The anti join needs the same clustering as the window, so the batch is shuffled once.
    """
    fresh = first_rows(batch, key, order, required, by)
    if stored is None:
        return fresh
    return fresh.join(stored.select(*by, *key), [*by, *key], "left_anti")


def row_key(columns: Sequence[str]) -> Column:
    """A digest of the values of a row, NULL if one of them is; zero has one sign."""
    parts = []
    for name in columns:
        value = F.col(name)
        text = F.when(value == 0, F.lit("0")).otherwise(value.cast("string")) if name == "amount" else value.cast("string")
        parts += [F.length(text).cast("string"), F.lit(":"), text]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def merge_ignore_keyed(
    batch: DataFrame,
    stored: DataFrame | None,
    key: Sequence[str] = TRANSACTION_KEY,
    order: str = "ord",
    required: Sequence[str] = ("date", "description", "amount"),
    by: Sequence[str] = (),
) -> DataFrame:
    """As ``merge_ignore``, with the key as one column ``row_key``, which stored rows have too.

    Where these are in Spark's buckets of it, only the batch is shuffled. A key with a NULL is NULL and
    equals nothing.
    """
    fresh = first_rows(batch, key, order, required, by).withColumn("row_key", row_key([*by, *key]))
    if stored is None:
        return fresh
    return fresh.join(stored.select("row_key"), "row_key", "left_anti")


def import_counts(batch: DataFrame, inserted: DataFrame) -> DataFrame:
    """One row: ``inserted`` and ``skipped`` = rows of the batch minus inserted."""
    done = inserted.agg(F.count("*").alias("inserted"))
    seen = batch.agg(F.count("*").alias("parsed"))
    # Two one-row aggregates side by side, as a union summed up: no join needed.
    both = done.withColumn("parsed", F.lit(0).cast("long")).unionByName(
        seen.withColumn("inserted", F.lit(0).cast("long"))
    )
    total = both.agg(F.sum("inserted").alias("inserted"), F.sum("parsed").alias("parsed"))
    return total.select("inserted", (F.col("parsed") - F.col("inserted")).alias("skipped"))


def merge_replace(
    stored: DataFrame | None, new: DataFrame, row: Sequence[str] = ("tax_year",), by: Sequence[str] = ()
) -> DataFrame:
    """Replaces whole rows: everything stored under a ``(by, row)`` of ``new`` goes, ``new`` comes in.

    Works on wide tables (columns missing on either side become NULL) and on the long form, where a
    field absent from ``new`` is thereby gone for the replaced rows.
    """
    if stored is None:
        return new
    replaced = new.select(*by, *row).distinct()
    kept = stored.join(replaced, [*by, *row], "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)
