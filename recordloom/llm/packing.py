"""Best-fit packing of tokenised documents, with certified numbers of bins."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.text_arrays import slices
from recordloom.operators.shared import saved

CAPACITY = 2048
TOKENIZER = "byte_bpe_50k"
#: Pieces that one task packs at once, about.
GROUP_PIECES = 1 << 14
#: Groups with gaps that meet in one group of the next round, and pieces that each hands over at most.
FAN_IN = 8
HAND_OVER = 1 << 12
PIECE = "_id {id}, piece int, start long, length long, ids_crc32 long"


@lru_cache(maxsize=2)
def _encoder(name: str):
    """Text to an array of ids. The ranks file holds the vocabulary of the tokenizer file of that name;
    its reader is several times faster and gives the same ids (tests compare both), also of the added
    tokens of the tokenizer file, which stand in texts as ids of their own."""
    import base64
    import json

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    with open(public_tokenizers.path(f"{name}.json"), encoding="utf-8") as file:
        added = {token["content"]: token["id"] for token in json.load(file)["added_tokens"]}
    encoding = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
    return lambda text: np.array(encoding.encode(text, allowed_special="all"), dtype="<u4")


def pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """The pieces of each document: its ids and the end id, cut from the end into runs of ``capacity``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer)
        end = np.array([end_id], dtype="<u4")
        for batch in slices(batches, "_text"):
            row, piece, start, length, crc = [], [], [], [], []
            for r, text in enumerate(batch.column("_text").to_pylist()):
                ids = np.concatenate([encode(text or ""), end])
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    row.append(r)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[a:b]))
            columns = [pa.array(piece, pa.int32()), *[pa.array(c, pa.int64()) for c in (start, length, crc)]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id").take(pa.array(row, pa.int64())), *columns],
                names=["_id", "piece", "start", "length", "ids_crc32"],
            )

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(work, PIECE.format(id=rows.schema["_id"].dataType.simpleString()))


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Bins that these sizes need at least: the best of two families of dual-feasible functions.

    A function f with sum f(x) <= 1 for all sets of sizes that fit a bin turns sizes into a bound on the
    number of bins. The first family counts sizes above ``capacity - t`` as 1 and drops those below t; the
    second rounds x * (k + 1) / capacity down to parts of 1 / k. Sums are in whole numbers, so the bound is
    exact.
    """
    if not len(sizes):
        return 0
    count = np.bincount(sizes, minlength=capacity + 1)
    x = np.arange(capacity + 1)
    many, volume = np.cumsum(count), np.cumsum(count * x)
    t = np.arange(0, capacity // 2 + 1)
    big = many[-1] - many[capacity - t]
    middle = volume[capacity - t] - np.where(t > 0, volume[np.maximum(t - 1, 0)], 0)
    best = int((big + -(-middle // capacity)).max())
    for k in range(1, 65):
        scaled = x * (k + 1)
        value = np.where(scaled % capacity == 0, x * k, (scaled // capacity) * capacity)
        best = max(best, -(-int((value * count).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each size, and the number of bins: longest first, into the fullest bin it fits."""
    bin_of, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    free, n = 0, 0  # bit r of free: there is a bin with r left
    for i, size in zip((order := np.argsort(-sizes, kind="stable")).tolist(), sizes[order].tolist(), strict=True):
        fits = free >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            b = open_bins[left].pop()
            if not open_bins[left]:
                free ^= 1 << left
        else:
            b, left, n = n, capacity, n + 1
        bin_of[i], offset[i] = b, capacity - left
        if left > size:
            open_bins[left - size].append(b)
            free |= 1 << (left - size)
    return bin_of, offset, n


def _pack_group(capacity: int, hand_over: int):
    def work(table: pa.Table) -> pa.Table:
        # Pieces in an order that does not depend on how they arrived.
        table = table.sort_by([("length", "descending"), ("_row", "ascending")])
        sizes = np.asarray(table.column("length"))
        bin_of, offset, n = best_fit_decreasing(sizes, capacity)
        gap = n - lower_bound(sizes, capacity)
        # The emptiest bins are given up, their pieces move on: as many as may be where there is a gap, else
        # the one that a group always has left over.
        filled = np.bincount(bin_of, weights=sizes, minlength=n)
        order = np.argsort(filled, kind="stable")
        held = np.cumsum(np.bincount(bin_of, minlength=n)[order])
        order = order[(held <= hand_over) & (filled[order] < capacity)]
        again = np.isin(bin_of, order if gap else order[:1])
        return table.append_column("bin", pa.array(bin_of)).append_column("offset", pa.array(offset)).append_column(
            "gap", pa.array(np.full(len(sizes), gap))
        ).append_column("again", pa.array(again))

    return work


def pack_pieces(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str = TOKENIZER,
    capacity: int = CAPACITY,
    end_id: int = 0,
    group_pieces: int = GROUP_PIECES,
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    Pieces of full length are sequences by themselves. The others are dealt at random into groups of a
    bounded size, each packed by best-fit decreasing. A lower bound by dual-feasible functions certifies
    groups that need no bin less. A group with a gap gives up its emptiest bins, a certified one only the
    bin it has left over; their pieces meet those of other groups and are packed again, until one group is
    left. Each round has an eighth of the groups, so rounds are few, and no group holds more than
    8 * 4096 pieces at any size.

    Null text is empty: one piece of the end id. Null ids and repeated rows are pieces of their own.
    Empty input gives no rows. Other columns are not read.
    """
    found = saved(pieces(docs, id_col, text_col, tokenizer, capacity, end_id).withColumn("_row", F.monotonically_increasing_id()))
    full = found.filter(F.col("length") == capacity)
    done = [full.select("*", (F.col("_row") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    rest = found.filter(F.col("length") < capacity)
    groups = -(-rest.count() // group_pieces)
    todo = rest.withColumn("_group", F.pmod(F.xxhash64("_id", "piece", "ids_crc32", "_row"), F.lit(max(1, groups))).cast("long"))
    columns, turn = found.columns, 0
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in todo.schema)
    schema += ", bin long, offset long, gap long, again boolean"
    while groups:
        packed = saved(todo.groupBy("_group").applyInArrow(_pack_group(capacity, HAND_OVER), schema))
        last = groups == 1
        closed = packed if last else packed.filter("not again")
        # Odd numbers: round, group (below 2^40) and bin (below 2^16); pieces of full length have even ones.
        number = ((F.lit(turn).cast("long") * (1 << 40) + F.col("_group")) * (1 << 16) + F.col("bin")) * 2 + 1
        done.append(closed.select(*columns, number.alias("sequence_id"), "offset"))
        if last:
            break
        todo = packed.filter("again").select(*columns, F.floor(F.col("_group") / FAN_IN).alias("_group"))
        left = todo.agg(F.countDistinct("_group")).first()[0]
        turn, groups = turn + 1, (-(-groups // FAN_IN) if left else 0)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select(F.col("_id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
