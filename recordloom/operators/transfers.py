"""Cancelling transfers between accounts.

The rule: inside one bucket (owner, date, cents) every positive amount, in input order, takes the
first unused negative amount of another account, and both rows go. Done row by row this is
sequential. It can be stated in counts instead:

Number the positives and the negatives of a bucket 1, 2, ... in input order and look at the pairs
(positive i, negative i). Keep a state (account s, count c), at first without account and c = 0:

* c = 0 and the two accounts differ: they take each other, c stays 0;
* c = 0 and both are account s: the positive must reach past negatives of s, so c = 1 for s;
* c > 0: c grows by the number of the two that belong to s, minus one.

Whenever c is back at 0 after pair i, exactly the first i positives and the first i negatives are
used. After the last such i only one account s is held back: from there on the positives of s take
the negatives of the other accounts in order, and the positives of the others take the negatives of
s in order. So for each bucket it is enough to know, for each of the four classes (sign, account is
s or not), how many of its first rows go. With two accounts no state is needed: c follows from the
counts alone. A class that goes in part needs one more figure, the input position of its last row
that goes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from recordloom.operators.shared import saved

# Most rows of one bucket that are handled together. `ord` is unique, so a block of this many consecutive
# `ord` values can never hold more rows than this, however many rows the bucket has.
BLOCK = 1 << 20
# Pairs whose state is folded in one array.
CHUNK = 1 << 16

_ALL = 2**63 - 1


def cancel_transfers(
    transactions: DataFrame, by: Sequence[str] = (), block: int = BLOCK, chunk: int = CHUNK
) -> DataFrame:
    """Transactions without the pairs that are one transfer between two accounts.

    Needs ``date, amount, account_id, ord``; ``ord`` is a unique whole number giving the input order.

    The counts of the buckets that can hold a transfer are computed first and saved, since every later
    step starts from them, and steps that no bucket needs are left out. In all, the transactions are
    read once for the counts, once for the result, and once more, only key columns, for classes that
    go in part and for buckets of three and more accounts.
    """
    keyed = transactions.withColumns(_keys())
    narrow = keyed.select(*_bucket(by), "_sign", "account_id", "ord")
    counted = saved(_counted(narrow, by).filter(F.expr(_CAN_HOLD) | (F.col("_rows") > block)))
    splitting = _Blocks(narrow, counted, by, block)
    buckets = counted.filter(_CAN_HOLD).drop("_rows")
    rows = splitting.split(narrow.filter("_sign <> 0"))
    held = buckets.filter("_accounts = 2").withColumn("_lead", F.lit(0).cast("long")).drop("_accounts")
    many = buckets.filter("_accounts > 2")
    if not many.isEmpty():
        held = held.unionByName(_held_account(rows, splitting, many, by, chunk))
    classes = saved(_quotas(held, _bucket(by)))
    plan = splitting.spread(_cuts(rows, splitting, classes, by))
    gone = _in_class(by) & (F.col("t.ord") <= F.col("c.cut"))
    everything = splitting.split(keyed)
    return everything.alias("t").join(plan.alias("c"), gone, "left_anti").drop("_cents", "_sign", "_block")


def _keys() -> dict[str, Column]:
    # NaN is no amount.
    amount = F.when(~F.isnan(F.col("amount").cast("double")), F.col("amount"))
    # Rows without amount get a bucket of their own kind: NULL keys would all meet in one task.
    return {
        "_cents": F.coalesce(F.round(F.abs(amount), 2), F.lit(-1.0)),
        "_sign": F.coalesce(F.signum(amount).cast("int"), F.lit(0)),
    }


def _bucket(by: Sequence[str]) -> list[str]:
    return [*by, "date", "_cents"]


# A bucket can hold a transfer when it has both signs and more than one account.
_CAN_HOLD = "_accounts > 1 and _all_pos > 0 and _all_neg > 0"


def _counted(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts per bucket: rows, accounts and rows per sign, and those of its first account."""
    bucket = _bucket(by)
    per_account = (
        rows.groupBy(*bucket, "account_id")
        .agg(
            F.count("*").alias("_rows"),
            F.count_if(F.col("_sign") > 0).alias("_pos"),
            F.count_if(F.col("_sign") < 0).alias("_neg"),
        )
        .withColumn("_account", F.when(F.col("_pos") + F.col("_neg") > 0, F.col("account_id")))
    )
    return per_account.groupBy(*bucket).agg(
        F.sum("_rows").alias("_rows"),
        F.count("_account").alias("_accounts"),
        F.sum("_pos").alias("_all_pos"),
        F.sum("_neg").alias("_all_neg"),
        F.min("_account").alias("_held"),
        F.min_by("_pos", "_account").alias("_held_pos"),
        F.min_by("_neg", "_account").alias("_held_neg"),
    )


class _Blocks:
    """Splits large buckets into blocks of `ord`.

    Every join, group and window over rows has `_block` in its key. It is -1 for all buckets but those
    of more than `block` rows, where it is the block of `ord`: no task ever gets more than `block` rows
    of one bucket. The list of large buckets is at most (all rows / block) long, which is why it may be
    broadcast.
    """

    def __init__(self, rows: DataFrame, buckets: DataFrame, by: Sequence[str], block: int):
        self._bucket, self._block = _bucket(by), block
        large = buckets.filter(F.col("_rows") > block).select(*self._bucket, F.lit(True).alias("_is_large"))
        self._large = None if large.isEmpty() else F.broadcast(large)
        if self._large is not None:
            inside = rows.join(self._large, self._bucket)
            self._blocks = saved(inside.select(*self._bucket, self._number().alias("_its")).distinct())

    def _number(self) -> Column:
        return F.call_function("div", F.col("ord"), F.lit(self._block).cast("long"))

    def split(self, rows: DataFrame) -> DataFrame:
        """Rows with their `_block`."""
        if self._large is None:
            return rows.withColumn("_block", F.lit(-1).cast("long"))
        number = F.when(F.col("_is_large"), self._number()).otherwise(F.lit(-1))
        return rows.join(self._large, self._bucket, "left").withColumn("_block", number).drop("_is_large")

    def spread(self, per_bucket: DataFrame) -> DataFrame:
        """Rows that hold for a whole bucket, repeated for each of its blocks."""
        if self._large is None:
            return per_bucket.withColumn("_block", F.lit(-1).cast("long"))
        blocks = per_bucket.join(self._blocks, self._bucket, "left")
        return blocks.withColumn("_block", F.coalesce("_its", F.lit(-1))).drop("_its")


def _in_class(by: Sequence[str]) -> Column:
    """Row ``t`` belongs to class ``c``."""
    same = F.col("t._sign") == F.col("c._sign")
    for name in [*_bucket(by), "_block"]:
        same = same & (F.col(f"t.{name}") == F.col(f"c.{name}"))
    return same & (F.col("t.account_id").eqNullSafe(F.col("c._held")) == F.col("c._is_held"))


def _cuts(rows: DataFrame, splitting: _Blocks, classes: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per class the last ``ord`` that goes (``cut``)."""
    columns = [*_bucket(by), "_sign", "_held", "_is_held", "cut"]
    whole = classes.filter("_quota >= _size").withColumn("cut", F.lit(_ALL)).select(*columns)
    part = classes.filter("_quota < _size")
    return whole if part.isEmpty() else whole.unionByName(_cut_inside(rows, splitting, part, by).select(*columns))


def _quotas(held: DataFrame, bucket: list[str]) -> DataFrame:
    """Sizes and quotas of the four classes of each bucket.

    ``_lead`` is how many rows of the held account, of both signs, lie before the last return of the
    state to zero, minus the number of pairs before it.
    """
    held_pos, held_neg = F.col("_held_pos"), F.col("_held_neg")
    rest_pos, rest_neg = F.col("_all_pos") - held_pos, F.col("_all_neg") - held_neg
    over = held_pos - rest_neg - F.col("_lead")  # positives of the held account left without partner
    under = rest_pos - held_neg + F.col("_lead")  # positives of the others left without partner
    zero = F.lit(0).cast("long")

    def one(sign: int, is_held: bool, size: Column, left: Column) -> Column:
        return F.struct(
            F.lit(sign).alias("_sign"),
            F.lit(is_held).alias("_is_held"),
            size.alias("_size"),
            (size - F.greatest(left, zero)).alias("_quota"),
        )

    classes = F.array(
        one(1, True, held_pos, over),
        one(-1, False, rest_neg, -over),
        one(1, False, rest_pos, under),
        one(-1, True, held_neg, -under),
    )
    return held.select(*bucket, "_held", F.inline(classes)).filter("_quota > 0")


def _cut_inside(rows: DataFrame, splitting: _Blocks, classes: DataFrame, by: Sequence[str]) -> DataFrame:
    """The `ord` of the `_quota`-th row of each class, without sorting a large class in one task.

    Rows are counted per block; running sums of those counts tell the block the quota falls into,
    and only the rows of that block are numbered.
    """
    group = [*_bucket(by), "_sign", "_held", "_is_held"]
    inside = (
        rows.alias("t")
        .join(splitting.spread(classes).alias("c"), _in_class(by))
        .select(*[f"c.{name}" for name in group], "c._block", "c._quota", "t.ord")
    )
    counts = inside.groupBy(*group, "_block").agg(F.count("*").alias("_n"), F.min("_quota").alias("_quota"))
    in_order = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)
    reached = (
        counts.withColumn("_upto", F.sum("_n").over(in_order))
        .filter("_upto >= _quota and _upto - _n < _quota")
        .select(*group, "_block", (F.col("_quota") - F.col("_upto") + F.col("_n")).alias("_rest"))
    )
    # `_held` is NULL where no account is held back, so it must not be a join key; the others suffice.
    keys = [*_bucket(by), "_sign", "_is_held", "_block"]
    numbered = Window.partitionBy(*keys).orderBy("ord")
    return (
        inside.select(*keys, "ord")
        .join(reached, keys)
        .withColumn("_n", F.row_number().over(numbered))
        .filter("_n = _rest")
        .withColumn("cut", F.col("ord"))
    )


# ---------------------------------------------------------------- three and more accounts


def _held_account(
    rows: DataFrame, splitting: _Blocks, buckets: DataFrame, by: Sequence[str], chunk: int
) -> DataFrame:
    """The account held back at the end of each bucket, with its counts and ``_lead``."""
    bucket = _bucket(by)
    totals = buckets.select(*bucket, "_all_pos", "_all_neg", F.least("_all_pos", "_all_neg").alias("_pairs_n"))
    numbered = saved(_numbered(rows, splitting, totals.select(*bucket, "_pairs_n"), by))
    pairs = _pairs(numbered, bucket)
    short = _chunks(pairs.filter(F.col("_pairs_n") <= chunk), bucket)
    ends = _fold(short, rows.schema["account_id"].dataType).select(*bucket, "_end.*")
    if not totals.filter(F.col("_pairs_n") > chunk).isEmpty():
        ends = ends.unionByName(_fold_long(pairs.filter(F.col("_pairs_n") > chunk), bucket, chunk))

    # Rows of each account, and how many of them are among the pairs.
    accounts = numbered.groupBy(*bucket, F.col("account_id").alias("held")).agg(
        F.count_if(F.col("_sign") > 0).alias("_held_pos"),
        F.count_if(F.col("_sign") < 0).alias("_held_neg"),
        F.count_if(F.col("_i") < F.col("_pairs_n")).alias("_met"),
    )
    # Nothing is held where the state ended free.
    held = ends.filter("held is not null").join(accounts, [*bucket, "held"])
    none = F.lit(0).cast("long")
    return totals.join(held, bucket, "left").select(
        *bucket,
        "_all_pos",
        "_all_neg",
        F.col("held").alias("_held"),
        F.coalesce("_held_pos", none).alias("_held_pos"),
        F.coalesce("_held_neg", none).alias("_held_neg"),
        (F.coalesce("_met", none) - F.col("_pairs_n") - F.coalesce("count", none)).alias("_lead"),
    )


def _numbered(rows: DataFrame, splitting: _Blocks, totals: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows of the buckets with ``_i``, their number among the rows of their bucket and sign.

    Rows are numbered inside blocks, and the counts of the earlier blocks are added, so the numbering
    of one large bucket is spread over its blocks.
    """
    side = [*_bucket(by), "_sign"]
    inside = rows.join(splitting.spread(totals), [*_bucket(by), "_block"])
    before = Window.partitionBy(*side).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        inside.groupBy(*side, "_block")
        .agg(F.count("*").alias("_n"))
        .select(*side, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    in_block = Window.partitionBy(*side, "_block").orderBy("ord")
    return inside.join(offsets, [*side, "_block"]).select(
        *side, "_pairs_n", "account_id", (F.col("_offset") + F.row_number().over(in_block) - 1).alias("_i")
    )


def _pairs(numbered: DataFrame, bucket: list[str]) -> DataFrame:
    """``(bucket, _pairs_n, _i, pos, neg)``: the accounts of the i-th positive and negative."""
    account = F.col("account_id")
    return (
        numbered.filter("_i < _pairs_n")
        .groupBy(*bucket, "_pairs_n", "_i")
        .agg(
            F.max(F.when(F.col("_sign") > 0, account)).alias("pos"),
            F.max(F.when(F.col("_sign") < 0, account)).alias("neg"),
        )
    )


def _chunks(pairs: DataFrame, bucket: list[str]) -> DataFrame:
    """One row per bucket of at most one chunk, with its pairs in order."""
    ordered = F.sort_array(F.collect_list(F.struct("_i", "pos", "neg")))
    return pairs.groupBy(*bucket).agg(ordered.alias("_pairs"))


def _state(kind: DataType, held: Column, count: Column) -> Column:
    return F.struct(held.cast(kind).alias("held"), count.cast("long").alias("count"))


def _after(kind: DataType, pairs: str, begin: Column) -> Column:
    """The state after an array of pairs, from the state ``begin`` (the rule in the module text)."""

    def step(before: Column, pair: Column) -> Column:
        held, count, pos, neg = before["held"], before["count"], pair["pos"], pair["neg"]
        grown = count + (pos == held).cast("long") + (neg == held).cast("long") - 1
        free = count == 0
        count_after = F.when(free, (pos == neg).cast("long")).otherwise(grown)
        held_after = F.when(free & (pos == neg), pos).when(~free & (grown > 0), held)
        return _state(kind, held_after, count_after)

    return F.aggregate(pairs, begin, step)


def _fold(chunks: DataFrame, kind: DataType) -> DataFrame:
    """Adds ``_end``: the state after the pairs of each bucket."""
    return chunks.withColumn("_end", _after(kind, "_pairs", _state(kind, F.lit(None), F.lit(0)))).drop("_pairs")


# ---- buckets of many chunks, by summaries of the chunks
#
# A chunk turns the state before it into the state after it. Three cases need only a summary of the chunk:
# nothing is held before it (the state after it is worked out once); an account is held so often that the
# pairs without it cannot use it up (its number changes by a sum); or the state before it has been met. So
# the summaries of a bucket are folded in order; where a state is met that needs the pairs, it is noted, the
# state after the chunk is guessed, and the fold goes on. All noted states are then worked out at once, a
# chunk per task, and the fold is repeated with what is known. The first open chunk is always settled, and
# as most chunks end alike whatever went before, a few turns do. Buckets still open after ``TURNS`` turns,
# and those of too many chunks for one fold, are left to the doubling below.

TURNS = 12
#: Chunks of a bucket that one fold takes; a summary has some hundred bytes.
MOST_CHUNKS = 1 << 19
#: An account in less than one of so many pairs of a chunk is not in its summary: at most twice as many are.
LISTED = 8


def _fold_long(pairs: DataFrame, bucket: list[str], chunk: int, turns: int = TURNS) -> DataFrame:
    """``(bucket, held, count)``: the state after all pairs of each bucket."""
    pairs = saved(pairs)
    kind = pairs.schema["pos"].dataType
    usual = F.col("_pairs_n") <= MOST_CHUNKS * chunk
    ends, left = _fold_summaries(pairs.filter(usual), bucket, chunk, kind, turns)
    rest = pairs.filter(~usual)
    if left is not None:
        rest = rest.unionByName(pairs.join(left, bucket, "left_semi"))
    if rest.isEmpty():
        return ends
    return ends.unionByName(_fold_by_doubling(rest, bucket, chunk))


def _fold_summaries(
    pairs: DataFrame, bucket: list[str], chunk: int, kind: DataType, turns: int
) -> tuple[DataFrame, DataFrame | None]:
    """The states at the end of the buckets that are settled, and the buckets that are not."""
    key = [*bucket, "_chunk"]
    pairs = pairs.withColumn("_chunk", _chunk_of("_i", chunk))
    parts = saved(pairs.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("_i", "pos", "neg"))).alias("_pairs")))
    free = parts.select(*key, F.size("_pairs").cast("long").alias("_m"), _after(kind, "_pairs", _state(kind, F.lit(None), F.lit(0))).alias("_free"))
    both = F.col("pos") == F.col("neg")
    two, one = F.lit(2).cast("long"), F.lit(1).cast("long")
    met = F.when(both, F.array(F.struct(F.col("pos").alias("held"), two.alias("_here")))).otherwise(
        F.array(*[F.struct(F.col(side).alias("held"), one.alias("_here")) for side in ("pos", "neg")])
    )
    present = pairs.select(*key, F.inline(met)).groupBy(*key, "held").agg(F.sum("_here").alias("_rows"), F.count("*").alias("_met"))
    listed = present.join(free.select(*key, "_m"), key).filter(F.col("_met") * LISTED >= F.col("_m"))
    entry = F.struct("held", (F.col("_m") - F.col("_met")).alias("absent"), (F.col("_rows") - F.col("_m")).alias("change"))
    listed = listed.groupBy(*key).agg(F.collect_list(entry).alias("_listed"))
    summaries = saved(free.join(listed, key, "left"))

    known = None
    for turn in range(turns + 1):
        rows = summaries
        if known is not None:
            pair = F.struct(F.col("_begin"), F.col("_end"), F.col("_turn"))
            rows = rows.join(known.groupBy(*key).agg(F.sort_array(F.collect_list(pair.alias("p"))).alias("_known")), key, "left")
        else:
            state = f"struct<held: {kind.simpleString()}, count: bigint>"
            rows = rows.withColumn("_known", F.lit(None).cast(f"array<struct<_begin: {state}, _end: {state}, _turn: int>>"))
        fields = F.struct("_chunk", "_m", "_free", "_listed", "_known")
        folded = rows.groupBy(*bucket).agg(F.array_sort(F.collect_list(fields), _in_order).alias("_all"))
        folded = saved(folded.select(*bucket, _folded(kind).alias("f")))
        settled = folded.filter(F.size("f.open") == 0).select(*bucket, "f.state.held", "f.state.count")
        opened = folded.filter(F.size("f.open") > 0)
        if opened.isEmpty():
            return settled, None
        if turn == turns:
            return settled, opened.select(*bucket)
        wanted = opened.select(*bucket, F.explode("f.open").alias("o")).select(*bucket, "o._chunk", F.col("o.state").alias("_begin"))
        found = parts.join(wanted, key).select(*key, "_begin", _after(kind, "_pairs", F.col("_begin")).alias("_end"), F.lit(turn).alias("_turn"))
        found = saved(found)
        known = found if known is None else known.unionByName(found)
    raise AssertionError("the last turn returns")


def _in_order(a: Column, b: Column) -> Column:
    return F.when(a["_chunk"] < b["_chunk"], -1).when(a["_chunk"] > b["_chunk"], 1).otherwise(0)


def _folded(kind: DataType) -> Column:
    """Over the summaries ``_all`` of a bucket in order: the state at the end, and the states that need pairs."""
    open_type = f"array<struct<_chunk: bigint, state: struct<held: {kind.simpleString()}, count: bigint>>>"
    begin = F.struct(_state(kind, F.lit(None), F.lit(0)).alias("state"), F.array().cast(open_type).alias("open"))

    def step(before: Column, part: Column) -> Column:
        held, count = before["state"]["held"], before["state"]["count"]
        entry = F.get(F.filter(part["_listed"], lambda e: e["held"] == held), F.lit(0))
        seen = F.filter(part["_known"], lambda k: (k["_begin"]["held"] == held) & (k["_begin"]["count"] == count))
        passes = F.coalesce(count > entry["absent"], F.lit(False))
        latest = F.try_element_at(F.array_sort(F.transform(part["_known"], lambda k: F.struct(k["_turn"].alias("t"), k["_end"].alias("e")))), F.lit(-1))
        guess = F.when(F.size(part["_known"]) > 0, latest["e"]).otherwise(part["_free"])
        is_known = F.coalesce(F.size(seen), F.lit(0)) > 0
        after = (
            F.when(count == 0, part["_free"])
            .when(is_known, F.get(seen, F.lit(0))["_end"])
            .when(passes, _state(kind, held, count + entry["change"]))
            .otherwise(guess)
        )
        asks = (count > 0) & ~is_known & ~passes
        item = F.struct(part["_chunk"].alias("_chunk"), _state(kind, held, count).alias("state"))
        return F.struct(
            _state(kind, after["held"], after["count"]).alias("state"),
            F.when(asks, F.concat(before["open"], F.array(item).cast(open_type))).otherwise(before["open"]).alias("open"),
        )

    return F.aggregate("_all", begin, step)


# ---- buckets of many chunks, by doubling
#
# Take "free after t pairs" as a place t. From a place whose next pair is of two accounts the state is free
# one pair later. If both are account s, the level of s, its rows so far less the pairs so far, rises by
# one with that pair, and the state is free again when the level is first back. Levels change by one at
# most, so the return is the next fall from the level reached, and rises and falls of one account and level
# take turns. Falls where s is absent need rows of their own, but only those that end a rise: never more
# than there are rises. So every place has one place it leads to, or is where the state ends, and the end
# of place 0 is found by doubling the steps: log2(pairs) rounds of joins, whatever the accounts are.
# Nothing is walked in order, and all windows are inside one chunk of places or over one figure per chunk.


def _fold_by_doubling(pairs: DataFrame, bucket: list[str], chunk: int) -> DataFrame:
    """``(bucket, held, count)``: the state after all pairs of each bucket."""
    pairs = saved(pairs.select(*bucket, "_pairs_n", (F.col("_i") + 1).alias("_at"), "pos", "neg"))
    levels = saved(_levels(pairs, bucket, chunk))
    rises = _returns(levels, bucket, chunk)
    kind = pairs.schema["pos"].dataType
    nothing, zero = F.lit(None).cast(kind), F.lit(0).cast("long")
    # Places before a pair of two accounts lead to the next rise of their chunk, or to the end of the chunk.
    later = Window.partitionBy(*bucket, "_chunk").orderBy("_at").rowsBetween(1, Window.unboundedFollowing)
    before_rise = F.when(F.col("pos") == F.col("neg"), F.col("_at") - 1)
    passed = (
        pairs.withColumn("_chunk", _chunk_of("_at", chunk))
        .withColumn("_to", F.coalesce(F.min(before_rise).over(later), F.max("_at").over(later), "_at"))
        .filter(before_rise.isNull())
        .select(*bucket, (F.col("_at") - 1).alias("_place"), "_to", nothing.alias("held"), zero.alias("count"))
    )
    last = pairs.filter("_at = _pairs_n").select(
        *bucket, F.col("_pairs_n").alias("_place"), F.lit(None).cast("long").alias("_to"),
        nothing.alias("held"), zero.alias("count"),
    )
    places = saved(passed.unionByName(rises).unionByName(last))
    return _end_of_first(places, bucket, pairs)


def _chunk_of(at: str, chunk: int) -> Column:
    return F.call_function("div", F.col(at), F.lit(chunk).cast("long"))


def _levels(pairs: DataFrame, bucket: list[str], chunk: int) -> DataFrame:
    """Per account and pair it is in: its level after the pair, and the falls after it that end a rise.

    ``_falls`` are those up to the account's next pair; ``_final`` is its level after all pairs.
    """
    both = F.col("pos") == F.col("neg")
    one, two = F.lit(1).cast("long"), F.lit(2).cast("long")
    found = F.when(both, F.array(F.struct(F.col("pos").alias("held"), two.alias("_here")))).otherwise(
        F.array(*[F.struct(F.col(side).alias("held"), one.alias("_here")) for side in ("pos", "neg")])
    )
    account, at = [*bucket, "held"], F.col("_at")
    in_chunk = Window.partitionBy(*account, "_chunk").orderBy("_at")
    upto = in_chunk.rowsBetween(Window.unboundedPreceding, 0)
    rows = (
        pairs.select(*bucket, "_pairs_n", "_at", F.inline(found))
        .withColumn("_chunk", _chunk_of("_at", chunk))
        .withColumn("_met", F.sum("_here").over(upto))
        # The level just before the pair, the lowest since the account's pair before it.
        .withColumn("_dip", F.col("_met") - F.col("_here") - at + 1)
        .withColumn("_low", F.min("_dip").over(upto))
        .withColumn("_next", F.lead("_at").over(in_chunk))
    )
    before = Window.partitionBy(*account).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*account)
    zero = F.lit(0).cast("long")
    chunks = (
        rows.groupBy(*account, "_chunk")
        .agg(F.sum("_here").alias("_all"), F.min("_dip").alias("_lowest"), F.min("_at").alias("_first"))
        .withColumn("_met_before", F.coalesce(F.sum("_all").over(before), zero))
        .withColumn("_total", F.sum("_all").over(whole))
        .withColumn("_low_before", F.least(F.min(F.col("_lowest") + F.col("_met_before")).over(before), zero))
        .withColumn("_next_first", F.lead("_first").over(Window.partitionBy(*account).orderBy("_chunk")))
        .select(*account, "_chunk", "_met_before", "_total", "_low_before", "_next_first")
    )
    level = F.col("_met_before") + F.col("_met") - at
    low = F.least(F.col("_low") + F.col("_met_before"), F.coalesce("_low_before", zero), zero)
    absent = F.coalesce("_next", "_next_first", F.col("_pairs_n") + 1) - at - 1
    return rows.join(chunks, [*account, "_chunk"]).select(
        *account,
        "_at",
        (F.col("_here") == 2).alias("_rise"),
        level.alias("_level"),
        F.least(absent, level - low).alias("_falls"),
        (F.col("_total") - F.col("_pairs_n")).alias("_final"),
    )


def _returns(levels: DataFrame, bucket: list[str], chunk: int) -> DataFrame:
    """Per rise the place it leads to, or, where its level is never left again, the state at the end."""
    key = [*bucket, "held", "_level"]
    none = F.lit(None).cast("long")
    rises = levels.filter("_rise").select(*key, "_at", F.lit(True).alias("_rise"), "_final")
    steps = F.lit(chunk).cast("long")
    # A long stretch of falls is written out by several tasks.
    parts = (
        levels.filter("_falls > 0")
        .select(*key, "_at", "_falls", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_falls") - 1, steps)).alias("_from"))
        .repartition(*key, "_at", "_from")
    )
    upto = F.least(F.col("_from") + steps, F.col("_falls")) - 1
    falls = parts.select(*key, "_at", F.explode(F.sequence("_from", upto)).alias("_k")).select(
        *bucket,
        "held",
        (F.col("_level") - F.col("_k")).alias("_level"),
        (F.col("_at") + F.col("_k") + 1).alias("_at"),
        F.lit(False).alias("_rise"),
        none.alias("_final"),
    )
    both = rises.unionByName(falls).withColumn("_chunk", _chunk_of("_at", chunk))
    in_chunk = Window.partitionBy(*key, "_chunk").orderBy("_at")
    turns = both.withColumn("_to", F.lead("_at").over(in_chunk)).filter("_rise")
    firsts = both.groupBy(*key, "_chunk").agg(F.min("_at").alias("_first"))
    after = firsts.select(
        *key, "_chunk", F.lead("_first").over(Window.partitionBy(*key).orderBy("_chunk")).alias("_later")
    )
    to = F.coalesce("_to", "_later")
    ended = to.isNull()
    return turns.join(after, [*key, "_chunk"]).select(
        *bucket,
        (F.col("_at") - 1).alias("_place"),
        to.alias("_to"),
        F.when(ended, F.col("held")).alias("held"),
        F.when(ended, F.col("_final") - F.col("_level") + 1).otherwise(F.lit(0)).alias("count"),
    )


def _end_of_first(places: DataFrame, bucket: list[str], pairs: DataFrame) -> DataFrame:
    """The state at the end of the way that starts at place 0.

    Each round doubles the way of every step. Only places that some step leads to can be met again, so
    the others are left out, and so are steps whose way has ended.
    """
    longest = pairs.agg(F.max("_pairs_n")).first()[0]
    # A place that leads nowhere is an end; a step that reaches one is done.
    ends = places.filter("_to is null").select(*bucket, F.col("_place").alias("_end"), "held", "count")
    marks = ends.select(*bucket, F.col("_end").alias("_to"), F.lit(True).alias("_done"))
    led = places.filter("_to is not null").select(*bucket, "_place", "_to")
    steps = led.join(marks, [*bucket, "_to"], "left").withColumn("_done", F.coalesce("_done", F.lit(False)))
    ways = saved(steps.select(*bucket, "_place", "_to", "_done"))
    for _ in range(rounds(longest)):
        if ways.filter("_place = 0 and not _done").isEmpty():
            break
        met = ways.filter("not _done").select(*bucket, F.col("_to").alias("_place")).distinct()
        first = ways.filter("_place = 0")
        needed = first.unionByName(ways.filter("_place <> 0").join(met, [*bucket, "_place"], "left_semi"))
        after = needed.select(
            *bucket, F.col("_place").alias("_to"), F.col("_to").alias("_farther"), F.col("_done").alias("_there")
        )
        doubled = (
            needed.filter("not _done")
            .join(after, [*bucket, "_to"])
            .select(*bucket, "_place", F.col("_farther").alias("_to"), F.col("_there").alias("_done"))
        )
        ways = saved(doubled.unionByName(needed.filter("_done")))
    first = ways.filter("_place = 0").select(*bucket, F.col("_to").alias("_end"))
    own = ends.filter("_end = 0").select(*bucket, "_end")
    return first.unionByName(own).join(ends, [*bucket, "_end"]).select(*bucket, "held", "count")


def rounds(pairs: int) -> int:
    """Most rounds that a bucket of so many pairs takes: a way has at most one step per pair."""
    return max(1, int(pairs).bit_length())
