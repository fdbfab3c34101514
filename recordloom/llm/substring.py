"""Substring deduplication by super-k-mer partitioning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.text_arrays import Pack, pack, raw_bytes, scramble, slices
from recordloom.operators.shared import saved

WINDOW = 20
#: Words of a minimiser.
MINIMISER = 5
#: Bytes of packed strings that a bucket should hold, about.
BUCKET_BYTES = 6 << 20
#: Bytes of text whose strings are packed together for a bucket.
PACK_BYTES = 8 << 20
#: Frequent minimisers that are split at most.
MAX_FREQUENT = 1 << 16
_EMPTY = np.zeros(0, dtype=np.int64)


def _squeeze(data: bytes) -> bytes:
    return pa.compress(data, "zstd", asbytes=True)


def _runs_of_windows(words: Pack, k: int, m: int, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, bucket key) of each super-k-mer.

    Consecutive windows of a row with one minimiser (the smallest hash of an m-word run in them) make one.
    Windows of a frequent minimiser are runs by themselves, keyed by the hash of the whole window.
    """
    begin = words.windows(k)
    if not len(begin):
        return _EMPTY, _EMPTY, np.zeros(0, np.uint64)
    n = len(words.starts) - m + 1
    runs = words.hash(words.starts[:n], words.ends[m - 1 :])
    # Minimum over each range of k - m + 1 hashes, from minima over ranges of doubled length.
    width, span, least = k - m + 1, 1, runs
    while span * 2 <= width:
        least = np.minimum(least[: len(least) - span], least[span:])
        span *= 2
    rest = width - span
    least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
    least = least[begin]
    cut = np.ones(len(begin), dtype=bool)
    cut[1:] = (least[1:] != least[:-1]) | (np.diff(begin) != 1) | np.diff(words.row[begin]).astype(bool)
    often = np.zeros(len(begin), dtype=bool)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, least), len(frequent) - 1)
        often = frequent[at] == least
        cut |= often
    first = np.flatnonzero(cut)
    count = np.diff(np.concatenate([first, [len(begin)]]))
    key = least[first]
    alone = often[first]
    if alone.any():
        i = begin[first[alone]]
        key[alone] = words.hash(words.starts[i], words.ends[i + k - 1])
    return begin[first], count, key


def _earliest(words: Pack, begin: np.ndarray, end: np.ndarray, place: tuple[np.ndarray, ...]) -> np.ndarray:
    """For byte ranges: whether equal bytes also stand at a smaller place (places compare in turn)."""
    key = words.hash(begin, end)
    order = np.argsort(key)
    twice = np.zeros(len(key), dtype=bool)
    met = key[order[1:]] == key[order[:-1]]
    twice[order[1:][met]] = twice[order[:-1][met]] = True
    rows = np.flatnonzero(twice)
    later = np.zeros(len(key), dtype=bool)
    if not len(rows):
        return later
    rows = rows[np.lexsort((*[p[rows] for p in reversed(place)], key[rows]))]
    head = np.ones(len(rows), dtype=bool)
    head[1:] = key[rows[1:]] != key[rows[:-1]]
    lead = rows[np.flatnonzero(head)[np.cumsum(head) - 1]]
    length = end[rows] - begin[rows]
    same = length == end[lead] - begin[lead]
    same[same] = words.same(begin[rows[same]], begin[lead[same]], length[same])
    if not same.all():  # texts that share a hash and differ: found by their bytes
        for bad in np.unique(key[rows[~same]]):
            group = rows[key[rows] == bad]
            seen: dict[bytes, int] = {}
            for r in group.tolist():
                one = seen.setdefault(words.data[begin[r] : end[r]].tobytes(), r)
                later[r] = any(p[r] != p[one] for p in place)
        fine = ~np.isin(key[rows], np.unique(key[rows[~same]]))
        rows, lead = rows[fine], lead[fine]
    differs = np.zeros(len(rows), dtype=bool)
    for p in place:
        differs |= p[rows] != p[lead]
    later[rows] = differs
    return later


def _frequencies(k: int, m: int, least: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            words = pack(*raw_bytes(batch.column("_text")))
            first, count, key = _runs_of_windows(words, k, m, np.zeros(0, np.uint64))
            text = words.hash(words.starts[first], words.ends[first + count + k - 2])
            _, one = np.unique(text, return_index=True)
            found, n = np.unique(key[one], return_counts=True)
            enough = n >= least
            yield pa.RecordBatch.from_arrays(
                [pa.array(found[enough].view(np.int64)), pa.array(n[enough])], names=["minimiser", "n"]
            )

    return work


def _pack_runs(k: int, m: int, buckets: int, frequent: np.ndarray):
    def flush(held: list) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        bucket = np.concatenate([h[0] for h in held])
        ids, hashes, starts = (np.concatenate([h[i] for h in held]) for i in (1, 2, 3))
        length = np.concatenate([h[4] for h in held])
        data = np.concatenate([h[5] for h in held])
        at = np.concatenate([[0], np.cumsum(length)])
        order = np.argsort(bucket, kind="stable")
        edges = np.flatnonzero(np.concatenate([[True], bucket[order][1:] != bucket[order][:-1]]))
        out: list[tuple] = []
        for a, b in zip(edges, [*edges[1:], len(order)], strict=True):
            rows = order[a:b]
            text = b"".join([data[at[r] : at[r + 1]].tobytes() for r in rows.tolist()])
            blobs = [np.ascontiguousarray(x[rows]).tobytes() for x in (ids, hashes, starts, length.astype(np.int32))]
            blobs = [_squeeze(x) for x in (*blobs, text)]
            out.append((int(bucket[rows[0]]), len(rows), len(text), *blobs))
        yield pa.RecordBatch.from_arrays(
            [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.int64())]
            + [pa.array([o[i] for o in out], pa.binary()) for i in range(3, 8)],
            names=["bucket", "n", "bytes", "ids", "hashes", "starts", "lengths", "packed"],
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, turn = [], 0, 0
        for batch in slices(batches, "_text"):
            ids = np.asarray(batch.column("_place").cast(pa.int64()))
            hashes = np.asarray(batch.column("_hash").cast(pa.int64()))
            words = pack(*raw_bytes(batch.column("_text")))
            first, count, key = _runs_of_windows(words, k, m, frequent)
            if not len(first):
                continue
            row = words.row[first]
            begin, end = words.starts[first], words.ends[first + count + k - 2]
            start = first - words.first[row]
            # A string that an earlier document of this slice has as well need not travel: all its windows
            # occur earlier. Its words are marked here.
            again = _earliest(words, begin, end, (ids[row], hashes[row], start))
            key = scramble(key) % np.uint64(buckets)
            go = ~again
            length = (end - begin)[go]
            upto = np.cumsum(length)
            inside = np.arange(upto[-1] if len(upto) else 0) - np.repeat(upto - length, length)
            data = words.data[np.repeat(begin[go], length) + inside]
            held.append((key[go].astype(np.int64), ids[row[go]], hashes[row[go]], start[go].astype(np.int32), length, data))
            size += len(data)
            if again.any():
                # Marked ranges pass through the next step, dealt evenly.
                turn += 1
                spread = int(scramble(np.array([int(ids[0]) & 0xFFFFFFFF, turn], np.uint64).sum(keepdims=True))[0] % np.uint64(buckets))
                blobs = [ids[row[again]], hashes[row[again]], start[again].astype(np.int32), (count[again] + k - 1).astype(np.int32)]
                blobs = [_squeeze(np.ascontiguousarray(x).tobytes()) for x in blobs]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([spread]), pa.array([int(again.sum())]), pa.array([-1])] + [pa.array([x], pa.binary()) for x in (*blobs, b"")],
                    names=["bucket", "n", "bytes", "ids", "hashes", "starts", "lengths", "packed"],
                )
            if size >= 3 * PACK_BYTES:
                yield from flush(held)
                held, size = [], 0
        yield from flush(held)

    return work


def _count_bucket(k: int):
    def unpack(value: bytes, n: int, kind) -> np.ndarray:
        return np.frombuffer(pa.decompress(value, n * np.dtype(kind).itemsize, "zstd", asbytes=True), dtype=kind)

    def work(table: pa.Table) -> pa.Table:
        marks, held = [], []
        for r in table.to_pylist():
            ids, hashes = (unpack(r[c], r["n"], np.int64) for c in ("ids", "hashes"))
            starts, lengths = (unpack(r[c], r["n"], np.int32).astype(np.int64) for c in ("starts", "lengths"))
            if r["bytes"] < 0:
                marks.append((ids, hashes, starts, starts + lengths))
            else:
                held.append((ids, hashes, starts, lengths, unpack(r["packed"], r["bytes"], np.uint8)))
        if held:
            ids, hashes, starts, lengths, data = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            words = pack(data, np.concatenate([[0], np.cumsum(lengths)]))
            window = words.windows(k)
            run = words.row[window]
            start = starts[run] + window - words.first[run]
            later = _earliest(words, words.starts[window], words.ends[window + k - 1], (ids[run], hashes[run], start))
            run, start = run[later], start[later]
            cut = np.ones(len(run), dtype=bool)
            cut[1:] = (run[1:] != run[:-1]) | (start[1:] != start[:-1] + 1)
            first = np.flatnonzero(cut)
            n = np.diff(np.concatenate([first, [len(run)]]))
            marks.append((ids[run[first]], hashes[run[first]], start[first], start[first] + n + k - 1))
        columns = [np.concatenate(x) for x in zip(*marks, strict=True)] if marks else [_EMPTY] * 4
        return pa.table({name: pa.array(c.astype(np.int64)) for name, c in zip(("place", "hash", "begin", "end"), columns, strict=True)})

    return work


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "_text"):
        words = pack(*raw_bytes(batch.column("_text")))
        marks = batch.column("marks")
        of = np.repeat(np.arange(batch.num_rows), np.asarray(pc.fill_null(pc.list_value_length(marks), 0)))
        flat = marks.flatten()
        base = words.first[of]
        change = np.zeros(len(words.starts) + 1, dtype=np.int64)
        np.add.at(change, base + np.asarray(flat.field("begin")), 1)
        np.add.at(change, base + np.asarray(flat.field("end")), -1)
        keep = np.cumsum(change[:-1]) == 0
        # Each word with the space before it, but no space before the first one kept.
        length = np.diff(np.concatenate([[0], words.ends]))
        kept_bytes = np.repeat(keep, length)
        row = words.row
        kept = np.flatnonzero(keep)
        lead = kept[np.concatenate([[True], row[kept[1:]] != row[kept[:-1]]])] if len(kept) else kept
        spaced = lead[lead > words.first[row[lead]]]
        kept_bytes[words.starts[spaced] - 1] = False
        ends = np.concatenate([[0], words.ends])[words.first]
        ends = np.concatenate([[0], np.cumsum(kept_bytes)])[ends]
        text = words.data[kept_bytes].tobytes()
        texts = [text[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        removed = np.concatenate([[0], np.cumsum(~keep)])[words.first]
        columns = [batch.column(i) for i, c in enumerate(batch.schema.names) if c not in ("_text", "marks")]
        names = [c for c in batch.schema.names if c not in ("_text", "marks")]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(words.n_words), pa.array(np.diff(removed)), pa.array(texts, pa.binary())],
            names=[*names, "n_words", "n_removed", "kept_text"],
        )


def marked_ranges(rows: DataFrame, k: int, m: int, bucket_bytes: int) -> DataFrame:
    """(place, hash, begin, end): runs of words of a document that lie in windows which also start earlier."""
    total = rows.agg(F.coalesce(F.sum(F.octet_length("_text").cast("long")), F.lit(0))).first()[0]
    # Packed strings have about three times the bytes of the texts.
    buckets = max(1, 3 * total // bucket_bytes)
    # A minimiser whose strings would fill half a bucket is split. To be that frequent it must have its
    # share in some slice, so slices need not report rarer ones.
    limit = max(64, bucket_bytes // 400)
    per_slice = max(1, limit // max(1, total // (1 << 20)))
    counted = rows.mapInArrow(_frequencies(k, m, per_slice), "minimiser long, n long")
    counted = counted.groupBy("minimiser").agg(F.sum("n").alias("n")).filter(F.col("n") > limit)
    often = counted.orderBy(F.desc("n")).limit(MAX_FREQUENT).collect()  # 16 bytes each, 1 MB at most
    frequent = np.sort(np.array([r["minimiser"] for r in often], dtype=np.int64).view(np.uint64))
    packed = rows.mapInArrow(
        _pack_runs(k, m, int(buckets), frequent),
        "bucket long, n long, bytes long, ids binary, hashes binary, starts binary, lengths binary, packed binary",
    )
    return packed.groupBy("bucket").applyInArrow(_count_bucket(k), "place long, hash long, begin long, end long")


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WINDOW, m: int = MINIMISER, bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """One row per document: id, n_words, n_removed, kept_text (bytes: the words kept, joined by spaces).

    A word is removed if a window of k words that covers it also starts earlier: in a document with a
    smaller id, or before in its own. Consecutive windows that share their minimiser travel as one string
    to the minimiser's bucket, strings of a bucket compressed together. There windows are sorted by a hash
    and equal ones compared byte by byte with the earliest. Hot passages: equal strings of a slice travel
    once, and minimisers that would overfill a bucket have their windows dealt by the whole window instead.

    Ids must be whole numbers. Null text has no words. Null ids come after all others; documents that
    share an id are ordered by a hash of their text; rows that repeat id and text are one document, each
    row with its result. Empty input gives no rows. Other columns are not read.
    """
    place = F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), place.alias("_place"), F.xxhash64(text).alias("_hash"), text.alias("_text"))
    ranges = saved(marked_ranges(rows.select("_place", "_hash", "_text"), k, m, bucket_bytes).distinct())
    marks = ranges.groupBy("place", "hash").agg(F.collect_list(F.struct("begin", "end")).alias("marks"))
    found = rows.join(marks, (F.col("_place") == F.col("place")) & (F.col("_hash") == F.col("hash")), "left")
    found = found.select("_id", "_text", "marks")
    kind = docs.schema[id_col].dataType.simpleString()
    out = found.mapInArrow(_remove, f"_id {kind}, n_words long, n_removed long, kept_text binary")
    return out.withColumnRenamed("_id", id_col)


