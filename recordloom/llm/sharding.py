"""Shards of near-equal bytes by a k-d tree with distributed weighted medians."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.llm.running import BLOCK_ROWS, running_sums
from recordloom.operators.shared import saved

SHARDS = 24
#: Bins per node of one refinement, and the share of a node's bytes that a cut may be off.
BINS = 1 << 16
PRECISION = 1 / 4096
ROW_BYTES = 8
#: Bits of a value's place in its dimension, and of the hash that tells rows of one place apart.
_VALUE, _HASH = 16, 24


def _numeric(column: Column, low: float, high: float) -> Column:
    """A number on the scale 0 to 2^16 - 1; null is 0."""
    span = float(high) - float(low)
    if not span:
        return F.lit(0).cast("long")
    share = (column.cast("double") - F.lit(float(low))) / F.lit(span)
    return F.coalesce(F.floor(share * F.lit(float((1 << _VALUE) - 1))), F.lit(0)).cast("long")


def shard(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    numeric: tuple[str, ...] = ("doc_id", "n_chars"),
    labels: tuple[str, ...] = ("source", "lang"),
    shards: int = SHARDS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """One row per document: id, size, text_crc32, law, shard, slot, grown_shard.

    The tree splits all nodes of a level at once. A node that has to give k shards is cut along its widest
    dimension (numbers on a common scale, labels by a hash, so that equal labels stay together while they
    can) at the point that leaves floor(k / 2) of its k parts of the bytes below. The cut is a
    weighted quantile found by histograms: bytes per (node, bin), then the bins of the bin that holds the
    cut, until that bin has little enough. Rows with equal values are told apart by a hash of their id and
    text, and rows that repeat both by their number, so one value or row may hold any share of the bytes. All figures per node are tables; the driver only sees
    whether another refinement is needed.

    size is the UTF-8 bytes of the text (null: none) plus 8; the law is ``bytes``. Null metadata lies at
    the low end. Null ids and repeated rows are rows like others. Dimensions that the table lacks are left
    out. Empty input gives no rows. slot counts the rows of a shard from 0.
    """
    numeric = tuple(c for c in numeric if c in docs.columns)
    labels = tuple(c for c in labels if c in docs.columns)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("_id"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        *[F.col(c).cast("double").alias(f"_n{i}") for i, c in enumerate(numeric)],
        *[F.pmod(F.xxhash64(F.col(c)), F.lit(1 << _VALUE)).alias(f"_l{i}") for i, c in enumerate(labels)],
    )
    rows = _numbered(saved(rows.withColumn("_row", F.monotonically_increasing_id())))
    ends = rows.agg(F.count("*"), *[f(f"_n{i}") for i in range(len(numeric)) for f in (F.min, F.max)]).first()
    scaled = [_numeric(F.col(f"_n{i}"), ends[2 * i + 1] or 0, ends[2 * i + 2] or 0) for i in range(len(numeric))]
    hashed = F.pmod(F.xxhash64(F.col("_id"), F.col("text_crc32"), F.col("_copy")), F.lit(1 << _HASH))
    keys = [F.shiftleft(c, _HASH).bitwiseOR(hashed) for c in [*scaled, *[F.col(f"_l{i}") for i in range(len(labels))]]]
    dims = range(len(keys)) if keys else range(1)
    keys = keys or [hashed]
    tree = rows.select("_id", "size", "text_crc32", hashed.alias("_hash"), *[k.alias(f"_k{i}") for i, k in enumerate(keys)])
    tree = tree.withColumn("node", F.lit(0).cast("long")).withColumn("parts", F.lit(shards))
    for _ in range((shards - 1).bit_length() if ends[0] else 0):
        tree = saved(tree)
        tree = tree.join(_cuts(tree, dims), "node", "left")
        above = F.coalesce(F.col("_split") >= F.col("cut"), F.lit(False))
        split = F.element_at(F.array(*[F.col(f"_k{i}") for i in dims]), F.col("dim") + 1)
        below = F.floor(F.col("parts") / 2).cast("int")
        tree = tree.withColumn("_split", split).withColumn("_above", above)
        tree = tree.withColumn("node", F.when(F.col("_above"), F.col("node") + below).otherwise(F.col("node")))
        tree = tree.withColumn(
            "parts", F.when(F.col("parts") == 1, 1).when(F.col("_above"), F.col("parts") - below).otherwise(below)
        ).drop("dim", "cut", "_split", "_above")
    tree = saved(tree.select("_id", "size", "text_crc32", "_hash", F.col("node").cast("int").alias("shard")))
    per_shard = tree.groupBy(F.col("shard").alias("_of")).agg(F.count("*").alias("_rows"))
    tree = tree.join(saved(per_shard), F.col("shard") == F.col("_of"))
    block = F.floor(F.col("_hash") / F.lit(float(1 << _HASH)) * F.ceil(F.col("_rows") / block_rows))
    out = running_sums(tree, ["shard"], block.cast("long"), ["_hash", "_id", "text_crc32", "size"], {"slot": F.lit(1)})
    return out.select(
        F.col("_id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("slot") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _numbered(rows: DataFrame) -> DataFrame:
    """Adds ``_copy``, the number of a row among those with its id and text.

    The copies of one row may be a large share of all: they are numbered in blocks of the saved ``_row``.
    """
    key = ["_id", "text_crc32"]
    several = saved(rows.groupBy(*key).agg(F.count("*").alias("_n")).filter("_n > 1").select(*[F.col(c).alias(f"_of{c}") for c in key]))
    zero = F.lit(0).cast("long")
    if several.isEmpty():
        return rows.withColumn("_copy", zero).drop("_row")
    same = F.col("_id").eqNullSafe(F.col("_of_id")) & (F.col("text_crc32") == F.col("_oftext_crc32"))
    again = rows.join(several, same, "left_semi")
    block = F.shiftright("_row", BLOCK_ROWS.bit_length() - 1)
    again = running_sums(again, key, block, ["_row"], {"_copy": F.lit(1).cast("long")})
    return saved(rows.join(several, same, "left_anti").withColumn("_copy", zero).unionByName(again).drop("_row"))


def _cuts(tree: DataFrame, dims: range) -> DataFrame:
    """(node, dim, cut) for every node that has to give more than one shard.

    Numbers of nodes are the numbers of their first shard.
    """
    todo = tree.filter("parts > 1")
    widths = [F.max(f"_k{i}") - F.min(f"_k{i}") for i in dims]
    stats = todo.groupBy("node").agg(
        F.first("parts").alias("parts"),
        F.sum("size").cast("double").alias("bytes"),
        F.greatest(*widths, F.lit(-1), F.lit(-1)).alias("width"),
        *[w.alias(f"_w{i}") for i, w in zip(dims, widths, strict=True)],
        *[F.min(f"_k{i}").alias(f"_m{i}") for i in dims],
    )
    widest, low = F.lit(dims[-1]), F.col(f"_m{dims[-1]}")
    for i in reversed(dims[:-1]):
        wide = F.col(f"_w{i}") == F.col("width")
        widest, low = F.when(wide, i).otherwise(widest), F.when(wide, F.col(f"_m{i}")).otherwise(low)
    # The cut lies in [low, low + BINS * step); want bytes of that range are to stay below it.
    step = F.ceil((F.col("width") + 1) / BINS).cast("long")
    want = F.col("bytes") * F.floor(F.col("parts") / 2) / F.col("parts")
    state = stats.select("node", "bytes", widest.alias("dim"), low.alias("low"), step.alias("step"), want.alias("want"))
    while True:
        split = F.element_at(F.array(*[F.col(f"_k{i}") for i in dims]), F.col("dim") + 1)
        bins = todo.join(state, "node").withColumn("_bin", F.floor((split - F.col("low")) / F.col("step")))
        bins = bins.filter((split >= F.col("low")) & (F.col("_bin") < BINS))
        bins = bins.groupBy("node", "_bin").agg(F.sum("size").alias("held"), F.count("*").alias("rows"), *[F.first(c).alias(c) for c in state.columns[1:]])
        upto = Window.partitionBy("node").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
        bins = bins.withColumn("below", F.coalesce(F.sum("held").over(upto), F.lit(0)))
        # The first bin that reaches what is wanted.
        found = bins.filter((F.col("below") < F.col("want")) & (F.col("below") + F.col("held") >= F.col("want")))
        found = saved(
            found.select(
                "node",
                "bytes",
                "dim",
                (F.col("low") + F.col("_bin") * F.col("step")).alias("low"),
                F.col("step").alias("wide"),
                (F.col("want") - F.col("below")).alias("want"),
                "held",
                "rows",
            )
        )
        open_ = (F.col("held") > F.col("bytes") * PRECISION) & (F.col("wide") > 1) & (F.col("rows") > 1)
        # A cut goes to the nearer end of its last bin.
        nearer = F.when(F.col("want") * 2 < F.col("held"), F.col("low")).otherwise(F.col("low") + F.col("wide"))
        if found.filter(open_).isEmpty():
            return found.select("node", "dim", nearer.alias("cut"))
        step = F.ceil(F.col("wide") / BINS).cast("long")
        state = found.select("node", "bytes", "dim", "low", step.alias("step"), "want")
