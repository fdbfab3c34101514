"""Long ordered groups cut into ranges that many tasks can work on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.operators.shared import saved

#: Rows of a block at most: 2^16.
BLOCK_BITS = 16


def in_blocks(rows: DataFrame, by: Sequence[str], order: Sequence[str], bits: int = BLOCK_BITS) -> DataFrame:
    """The rows, saved, with ``_block``: a number that never falls along ``order`` inside an owner ``by``.

    Spark sorts by ranges whose limits are quantiles of a sample, so however close the values lie, each
    range is a task's share, and a range is cut into blocks of 2^bits rows by their number in it. What a
    block needs of the blocks before it is carried over one row per block.
    """
    ordered = saved(rows).orderBy(*by, *order)
    # Partition in the upper bits, number in the partition in the lower 33.
    return saved(ordered.withColumn("_block", F.shiftright(F.monotonically_increasing_id(), bits)))
