"""Merging windows and keeping the records that overlap them.

Starts and ends are texts and are compared as texts. A window is closed: touching is overlapping.

Where an owner has more rows than one task should get, its rows are sorted by ranges (``in_blocks``). What
the earlier blocks contribute is one figure per block, the largest end so far, so the rows are spread over
many tasks, also when they all lie in one hour, and only the owner's list of blocks is walked in order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from recordloom.operators.ordered import in_blocks
from recordloom.operators.shared import saved

# Windows of one owner, equal starts counted once, beyond which they are merged block by block.
LARGE_OWNER = 1 << 20
# Equal records that one task writes out.
MANY_COPIES = 1 << 16


def _block_of(text: Column, chars: int) -> Column:
    return F.substring(text, 1, chars)


def merge_intervals(
    windows: DataFrame,
    by: Sequence[str] = (),
    start: str = "start",
    end: str = "end",
    block_chars: int | None = None,
    large_owner: int = LARGE_OWNER,
) -> DataFrame:
    """Windows that overlap or touch, merged: ``(by, start, end, copies)``.

    Windows without start or end are left out. ``copies`` is 1, save that a window ending before it
    starts never merges with its equals and stands for that many of them. With ``block_chars`` the blocks
    of a large owner are the first characters of the start instead of ranges.
    """
    backwards = F.when(F.col("end") < F.col("start"), F.col("end"))
    # Of windows with the same start only the longest matters, so equal starts are reduced first.
    rows = saved(
        windows.select(*by, F.col(start).alias("start"), F.col(end).alias("end"))
        .filter("start <> '' and end <> ''")
        .groupBy(*by, "start", backwards.alias("_backwards"))
        .agg(F.max("end").alias("end"), F.count("*").alias("copies"))
        .select(
            *by,
            "start",
            "end",
            F.when(F.col("_backwards").isNull(), 1).otherwise(F.col("copies")).alias("copies"),
        )
    )
    large = rows.groupBy(*by).agg(F.count("*").alias("_n")).filter(F.col("_n") > large_owner).drop("_n")
    if not by:
        return _merge_in_blocks(rows, by, block_chars) if rows.count() > large_owner else _merge(rows, by)
    if large.isEmpty():
        return _merge(rows, by)
    large = saved(large)
    usual = _merge(rows.join(large, list(by), "left_anti"), by)
    return usual.unionByName(_merge_in_blocks(rows.join(large, list(by), "left_semi"), by, block_chars))


def _pieces(rows: DataFrame, key: Sequence[str], carried: Column | None = None) -> DataFrame:
    """Merged rows of each key, numbered; number 0 goes on from ``carried``, the end reached before."""
    ordered = Window.partitionBy(*key).orderBy("start", "end")
    reached = F.max("end").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    if carried is not None:
        reached = F.greatest(reached, carried)
    opens = F.coalesce(F.col("start") > F.col("_reached"), F.lit(True))
    return (
        rows.withColumn("_reached", reached)
        .withColumn("_opens", opens)
        .withColumn("_nth", F.count_if("_opens").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*key, "_nth")
        .agg(
            F.min("start").alias("start"),
            F.max("end").alias("end"),
            F.max(F.when(F.col("_opens"), F.col("copies"))).alias("copies"),
        )
    )


def _merge(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    return _pieces(rows, by).select(*by, "start", "end", "copies")


def _merge_in_blocks(rows: DataFrame, by: Sequence[str], chars: int | None) -> DataFrame:
    key = [*by, "_block"]
    if chars is None:
        rows = in_blocks(rows, by, ["start", "end"])
    else:
        rows = rows.withColumn("_block", _block_of(F.col("start"), chars))
    earlier = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy(*key).agg(F.max("end").alias("_block_end"))
    carried = ends.select(*key, F.max("_block_end").over(earlier).alias("_carried"))
    pieces = saved(_pieces(rows.join(carried, key), key, F.col("_carried")))

    # Piece 0 of a block goes on with the window that was opened last in the blocks before it.
    own = F.col("_nth") > 0
    opened = pieces.groupBy(*key).agg(F.max(F.when(own, F.col("start"))).alias("_last"))
    going_on = opened.select(*key, F.max("_last").over(earlier).alias("_from"))
    backwards = F.when(own & (F.col("end") < F.col("start")), F.col("end"))
    return (
        pieces.join(going_on, key)
        .groupBy(*by, F.when(own, F.col("start")).otherwise(F.col("_from")).alias("start"), backwards.alias("_alone"))
        .agg(F.max("end").alias("end"), F.max("copies").alias("copies"))
        .select(*by, "start", "end", "copies")
    )


def interval_overlap(
    records: DataFrame,
    windows: DataFrame,
    by: Sequence[str] = (),
    start: str = "start",
    end: str = "end",
    levels: Sequence[int] | None = None,
    large_owner: int = LARGE_OWNER,
) -> DataFrame:
    """Records that overlap one of the merged windows ``(by, start, end)``; those without dates do not.

    A record overlaps exactly when, of the windows that start no later than it ends, the largest end is no
    earlier than its start. So only the different ends of records are put among the starts of windows, and
    the largest end of a window is carried along: in one window per owner, for large owners over ranges of
    the texts, or with ``levels`` over prefixes of these lengths and inside the longest. The ends where an
    overlap is possible are saved; as their real size is then known, Spark sends them to the records where
    they are small enough, which are then not shuffled.
    """
    dated = records.filter(F.col(start).isNotNull() & F.col(end).isNotNull())
    ends = dated.groupBy(*by, F.col(end).alias("_at")).agg(F.min(start).alias("_first"))
    starts = windows.groupBy(*by, F.col("start").alias("_at")).agg(F.max("end").alias("_to"))
    points = ends.join(starts, [*by, "_at"], "full")
    reached = _largest_in_prefixes(points, by, levels) if levels else _largest_so_far(points, by, large_owner)
    reached = reached.filter("_first <= _reached")
    kept = saved(reached.select(*by, F.col("_at").alias("_end"), "_reached"))
    met = (F.col(f"r.{end}") == F.col("k._end")) & (F.col(f"r.{start}") <= F.col("k._reached"))
    for name in by:
        met = met & (F.col(f"r.{name}") == F.col(f"k.{name}"))
    return dated.alias("r").join(kept.alias("k"), met, "left_semi")


def _largest_so_far(points: DataFrame, by: Sequence[str], large_owner: int) -> DataFrame:
    """Points with ``_reached``, the largest ``_to`` of their owner up to and with their own ``_at``."""
    points = saved(points)

    def whole(rows: DataFrame) -> DataFrame:
        upto = Window.partitionBy(*by).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumn("_reached", F.max("_to").over(upto))

    def by_ranges(rows: DataFrame) -> DataFrame:
        rows = in_blocks(rows, by, ["_at"])
        key = [*by, "_block"]
        earlier = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        inside = Window.partitionBy(*key).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
        carried = rows.groupBy(*key).agg(F.max("_to").alias("_most")).withColumn("_carried", F.max("_most").over(earlier))
        rows = rows.withColumn("_own", F.max("_to").over(inside)).join(carried.drop("_most"), key)
        return rows.withColumn("_reached", F.greatest("_own", "_carried"))

    if not by:
        return by_ranges(points) if points.count() > large_owner else whole(points)
    large = saved(points.groupBy(*by).count().filter(F.col("count") > large_owner).drop("count"))
    if large.isEmpty():
        return whole(points)
    names = [*points.columns, "_reached"]
    usual = whole(points.join(large, list(by), "left_anti"))
    return usual.select(*names).unionByName(by_ranges(points.join(large, list(by), "left_semi")).select(*names))


def _largest_in_prefixes(points: DataFrame, by: Sequence[str], levels: Sequence[int]) -> DataFrame:
    """Points with ``_reached``, the largest ``_to`` of their owner up to and with their own ``_at``.

    A prefix of a text sorts as the text does. The largest ``_to`` of each prefix is carried over the
    prefixes that share the next shorter one, so a task gets the days of a month, the hours of a day and
    so on, and never the points of a whole owner.
    """
    names = [f"_p{chars}" for chars in levels]
    rows = points.withColumns({name: F.substring("_at", 1, chars) for name, chars in zip(names, levels)})
    finest = rows.groupBy(*by, *names).agg(F.max("_to").alias("_to"))
    earlier = finest.select(*by, *names)
    for depth, name in enumerate(names):
        key = [*by, *names[:depth]]
        before = Window.partitionBy(*key).orderBy(name).rowsBetween(Window.unboundedPreceding, -1)
        level = finest.groupBy(*key, name).agg(F.max("_to").alias("_to"))
        carried = level.select(*key, name, F.max("_to").over(before).alias(f"_before{depth}"))
        earlier = earlier.join(carried, [*key, name])
    inside = Window.partitionBy(*by, *names).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    carried = [F.col(f"_before{depth}") for depth in range(len(names))]
    return (
        rows.withColumn("_own", F.max("_to").over(inside))
        .join(earlier, [*by, *names])
        .withColumn("_reached", F.greatest("_own", *carried))
    )


def keep_records(
    records: DataFrame,
    windows: DataFrame,
    by: Sequence[str] = (),
    force_types: Sequence[str] = (),
    type_column: str = "type",
    **options,
) -> DataFrame:
    """Records of the forced types, overlapping or not, and of the others those that overlap."""
    if not force_types:
        return interval_overlap(records, windows, by, **options)
    forced = F.coalesce(F.col(type_column).isin(list(force_types)), F.lit(False))
    rest = interval_overlap(records.filter(~forced), windows, by, **options)
    return records.filter(forced).unionByName(rest)


def top_level(
    records: DataFrame, parents: DataFrame, children: str, by: Sequence[str] = (), many: int = MANY_COPIES
) -> DataFrame:
    """Records without those that are children of ``parents``; each child removes one equal record.

    A reader that looks for a tag also returns the nested ones, so nested ones are taken off again.
    Equal records are counted, inside the map tasks first, and the copies left are written out again;
    a record with a great many copies is written out by several tasks. A child has its own attributes and
    the owner of its parent (``by``), nothing else of it.
    """
    one = isinstance(parents.schema[children].dataType, StructType)
    inside = F.inline(F.array(children) if one else F.col(children))
    nested = parents.filter(F.col(children).isNotNull()).select(*by, inside)
    # Attributes no child has are NULL there, as they are in the equal record.
    nested = nested.select(
        *[
            (F.col(f.name) if f.name in nested.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in records.schema
        ],
        F.lit(-1).alias("_n"),
    )
    columns = records.columns
    left = (
        records.withColumn("_n", F.lit(1))
        .unionByName(nested)
        .groupBy(*columns)
        .agg(F.sum("_n").alias("_n"))
        .filter("_n > 0")
    )
    n, most = F.col("_n"), F.lit(many).cast("long")
    parts = left.filter(n > most).select(
        *columns, "_n", F.explode(F.sequence(F.lit(0), F.call_function("div", n - 1, most))).alias("_part")
    )
    shared = parts.withColumn("_n", F.least(most, n - F.col("_part") * most)).repartition(*columns, "_part")

    def written_out(counted: DataFrame) -> DataFrame:
        return counted.select(*columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))).drop("col")

    return written_out(left.filter(n <= most)).unionByName(written_out(shared))


def element_counts(elements: DataFrame, by: Sequence[str] = (), kind: str = "kind") -> DataFrame:
    """Kept elements per kind."""
    return elements.groupBy(*by, kind).agg(F.count("*").alias("n"))
