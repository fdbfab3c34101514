"""Joins to a table of unique keys, where a few keys may hold most rows of the other side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.operators.shared import saved

#: A key is hot if more than one in so many rows hold it, so there are fewer hot keys than this.
HOT = 4096


def join_counted(left: DataFrame, right: DataFrame, keys: list[str], n: str) -> DataFrame:
    """The inner join; ``right`` is a saved table with unique keys and ``n``, how many rows of ``left`` hold each.

    Rows of hot keys stay in their map tasks: hot keys are less than HOT, whatever the size of the tables,
    and are broadcast. All others are shuffled, and none of them is more than a small part of the rows.
    """
    total = right.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    hot = saved(right.filter(F.col(n) * HOT > F.lit(total)))
    cold = right.filter(F.col(n) * HOT <= F.lit(total))
    if cold.isEmpty():
        return left.join(F.broadcast(hot), keys)
    if hot.isEmpty():
        return left.join(cold, keys)
    rest = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    return left.join(F.broadcast(hot), keys).unionByName(rest)
