"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.running import BLOCK_ROWS, running_sums
from recordloom.operators.shared import saved

WEIGHTS = (5, 2, 1)
#: No source and no document is taken more often than this.
REPEATS = 3
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sources: DataFrame, weights: Sequence[float], repeats: int) -> DataFrame:
    """Adds weight and target to a table of (source, source_size), one row per source.

    Sources in code point order, null last, take the weights in turn. All sizes together are shared by
    weight; a source above ``repeats`` times its size is held there and its excess shared among the others,
    again and again until none is above. A round is one small aggregate, whatever the number of sources;
    only sums reach the driver.
    """
    spark = sources.sparkSession
    ordered = sources.orderBy(F.col("source").asc_nulls_last())
    ranked = ordered.rdd.zipWithIndex().map(lambda x: (x[0]["source"], x[0]["source_size"], x[0]["n_rows"], x[1]))
    schema = f"source {sources.schema['source'].dataType.simpleString()}, source_size long, n_rows long, place long"
    table = spark.createDataFrame(ranked, schema)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    table = saved(table.withColumn("weight", weight))
    total = table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, held_before = 0.0, -1
    while True:
        held = F.col("source_size") * repeats < F.col("weight") * F.lit(level)
        held_size, held_rows, free = table.agg(
            F.coalesce(F.sum(F.when(held, F.col("source_size"))), F.lit(0)),
            F.count(F.when(held, True)),
            F.sum(F.when(~held, F.col("weight"))),
        ).first()
        if held_rows == held_before or not free:
            break
        held_before, level = held_rows, (total - repeats * held_size) / free
    target = F.when(held, F.col("source_size").cast("double") * repeats).otherwise(F.col("weight") * F.lit(float(level)))
    return table.withColumn("target", target.cast("double"))


def _served(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    source_col: str,
    weights: Sequence[float] = WEIGHTS,
    repeats: int = REPEATS,
    seed: str = "mix",
    block_rows: int = BLOCK_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """The queues, and the last unit (pass, place) that each source gives before the budget is spent."""
    rows = docs.select(
        F.col(id_col).alias("_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size")
    )
    rows = saved(rows.withColumn("_spread", _spread(F.col("_id"), seed)))
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    targets = saved(source_targets(sources, weights, repeats)).withColumnRenamed("source", "_of")
    # Few sources make a small table, which Spark broadcasts by its real size; many have no hot one to fear.
    rows = rows.join(targets, F.col("source").eqNullSafe(F.col("_of"))).drop("_of", "weight", "place")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n_rows") / block_rows))
    block = F.floor(F.col("_spread") / F.lit(float(1 << 48)) * blocks).cast("long")
    queue = running_sums(rows, ["source"], block, ["_spread", "_id", "size"], {"_queued": F.col("size")})
    queue = saved(queue)
    total, n_rows = queue.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    # A unit that begins beyond its target cannot be reached: the documents of each queue that are under way
    # when the budget runs out are the only ones beyond virtual time 1.
    begins = F.col("_pass") * F.col("source_size") + F.col("_queued") - F.col("size")
    units = queue.filter("size > 0").select("*", F.explode(F.array(*[F.lit(i) for i in range(repeats)])).alias("_pass"))
    finish = (F.col("_pass") * F.col("source_size") + F.col("_queued")) / F.col("target")
    units = units.filter(begins < F.col("target")).select("source", "_id", "_spread", "_pass", "size", finish.alias("_finish"))
    wide = max(1, -(-n_rows // block_rows))
    at = F.floor(F.least(F.col("_finish"), F.lit(2.0)) * wide).cast("long")
    order = ["_finish", "source", "_spread", "_id", "_pass", "size"]
    sent = running_sums(units.withColumn("_all", F.lit(0)), ["_all"], at, order, {"_spent": F.col("size")})
    # What is taken of a queue is its beginning, so its last unit tells all.
    taken = sent.filter(F.col("_spent") <= F.lit(total))
    last = taken.groupBy("source").agg(F.max(F.struct("_pass", "_spread", "_id", "size")).alias("last"))
    return queue, saved(last.select(F.col("source").alias("_of"), "last"))


def _spread(doc_id: Column, seed: str) -> Column:
    text = F.concat(F.lit(f"{seed}/"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")


def _passes(rows: DataFrame, last: DataFrame) -> DataFrame:
    """Adds ``passes`` to rows with source, _spread, _id and size: by the last unit taken of the source."""
    rows = rows.join(last, F.col("source").eqNullSafe(F.col("_of")), "left")
    place, end = F.struct("_spread", "_id", "size"), F.struct("last._spread", "last._id", "last.size")
    passes = F.col("last._pass") + F.when(place <= end, 1).otherwise(0)
    return rows.withColumn("passes", F.when((F.col("size") > 0) & F.col("last").isNotNull(), passes).otherwise(0)).drop("_of", "last")


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", **options
) -> DataFrame:
    """One row per document: id, size, source, source_size, target, passes, taken.

    Each source is a queue: its documents in a shuffled order that depends on id and seed only, the whole
    order ``repeats`` times over. A unit (document, pass) finishes at the virtual time
    ``tokens of the queue up to and with it / target of the source``. All units sorted by that time are
    taken until the total budget (all sizes together) is spent. Up to any virtual time each queue has
    given at most its share, so a source ends within one document of its target.

    Both running sums are made in blocks: the order inside a source is by hash, so equal ranges of the
    hash are equal blocks; the virtual time is evenly filled by design, so equal ranges of it are too.
    A source with a third of all rows has a third of the blocks.

    Null text has size 0; sizes of 0 are never taken (taken 0). Null sources are one source, the last.
    Null ids and repeated rows are documents like others; rows that are equal in id, source and size and
    meet the end of the budget are taken or left together. Empty input gives no rows. Other columns are
    not read.
    """
    queue, last = _served(docs, id_col, text_col, source_col, seed=seed, **options)
    return _passes(queue, last).select(
        F.col("_id").alias(id_col),
        "size",
        F.col("source").alias(source_col),
        "source_size",
        "target",
        "passes",
        (F.col("passes") * F.col("size")).alias("taken"),
    )


def mixed(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", **options
) -> DataFrame:
    """The documents as the mix takes them: each as often as it has passes, with all its columns.

    The texts stay where they are: the last unit of each source decides.
    """
    names = docs.columns
    docs = docs.toDF(*[f"_c{i}" for i in range(len(names))])  # no name of theirs can clash with ours
    id_col, text_col, source_col = (f"_c{names.index(c)}" for c in (id_col, text_col, source_col))
    _, last = _served(docs, id_col, text_col, source_col, seed=seed, **options)
    rows = docs.select(
        "*",
        F.col(source_col).alias("source"),
        F.col(id_col).alias("_id"),
        n_words(F.col(text_col)).alias("size"),
        _spread(F.col(id_col), seed).alias("_spread"),
    )
    rows = _passes(rows, last).filter("passes > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("passes").cast("int"))))
    return rows.select(*[f"_c{i}" for i in range(len(names))]).toDF(*names)
