"""Running sums over long ordered groups, without one task that sees a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one window partition should hold at most, about.
BLOCK_ROWS = 1 << 16


def running_sums(df: DataFrame, group: list[str], block: Column, order: list, sums: dict[str, Column]) -> DataFrame:
    """Adds, for each name in ``sums``, the sum of its column over the rows of the group up to and with this one.

    ``block`` is a whole number that never falls along ``order`` and cuts each group into blocks that a
    window can hold. The sums of whole blocks are added first (partial sums in the map tasks), then the
    running sum of blocks is joined to the running sum inside each block. Null groups are groups too.
    """
    df = df.withColumn("_block", block)
    inner = Window.partitionBy(*group, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    outer = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*group, "_block").agg(*[F.sum(c).alias(f"_{n}_whole") for n, c in sums.items()])
    totals = totals.select(
        *[F.col(g).alias(f"_of_{g}") for g in group],
        F.col("_block").alias("_of_block"),
        *[F.coalesce(F.sum(f"_{n}_whole").over(outer), F.lit(0)).alias(f"_{n}_before") for n in sums],
    )
    df = df.select("*", *[F.sum(c).over(inner).alias(f"_{n}_within") for n, c in sums.items()])
    on = F.col("_block") == F.col("_of_block")
    for g in group:
        on &= F.col(g).eqNullSafe(F.col(f"_of_{g}"))
    out = df.join(totals, on)
    for n in sums:
        out = out.withColumn(n, F.col(f"_{n}_before") + F.col(f"_{n}_within"))
    return out.drop("_block", "_of_block", *[f"_of_{g}" for g in group], *[f"_{n}_{x}" for n in sums for x in ("before", "within")])
