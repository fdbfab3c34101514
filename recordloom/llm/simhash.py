"""SimHash near-duplicates: fingerprints compared at the anchors of a covering code."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.components import components
from recordloom.llm.text_arrays import lower_ascii, pack, raw_bytes, slices
from recordloom.operators.shared import saved

SHINGLE = 3
THRESHOLD = 3
SEED = 42
#: Fingerprints at home at one anchor that one task compares with; more are split over several tasks.
HOMES = 1 << 14
#: Fixed value: generator polynomial of the perfect binary [23, 12] code with covering radius 3.
GOLAY = 0b101011100011


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(id, fp): bit b of fp is set if more than half of the hashes of the k-word shingles have it set.

    ASCII letters are lowered; a shingle is k consecutive words joined by a space, repeats counted; a text
    with fewer words is one shingle, a text without words (or null) has fingerprint 0.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in slices(batches, "_text"):
            data, offsets = raw_bytes(batch.column("_text"))
            words = pack(lower_ascii(data), offsets)
            text = words.text()
            short = np.flatnonzero((words.n_words > 0) & (words.n_words < k))
            begin = words.windows(k)
            end = words.ends[begin + k - 1]
            begin = np.concatenate([words.starts[begin], words.starts[words.first[short]]])
            end = np.concatenate([end, words.ends[words.first[short + 1] - 1]])
            row = np.concatenate([np.repeat(np.arange(batch.num_rows), np.maximum(words.n_words - k + 1, 0)), short])
            order = np.argsort(row, kind="stable")
            spans = zip(begin[order].tolist(), end[order].tolist(), strict=True)
            hashes = np.array([digest(text[a:b], seed) for a, b in spans], dtype=np.uint64)
            count = np.bincount(row, minlength=batch.num_rows)
            upto = np.concatenate([[0], np.cumsum(count)])
            fp = np.zeros(batch.num_rows, dtype=np.uint64)
            for r in np.flatnonzero(count):
                bits = np.unpackbits(hashes[upto[r] : upto[r + 1]].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                fp[r] = np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > count[r], bitorder="little").view(np.uint64)[0]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(fp.view(np.int64))], names=["_id", "fp"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    out = rows.mapInArrow(work, f"_id {rows.schema['_id'].dataType.simpleString()}, fp long")
    return out.withColumnRenamed("_id", id_col)


def _syndromes(x: np.ndarray) -> np.ndarray:
    x = x.copy()
    for bit in range(22, 10, -1):
        x ^= np.where((x >> bit) & 1, GOLAY << (bit - 11), 0)
    return x


@cache
def _cosets() -> tuple[np.ndarray, list[np.ndarray]]:
    """For each syndrome of the 23-bit code its error of weight 3 at most, and its errors of weight 4."""
    errors = [[sum(1 << b for b in bits) for bits in combinations(range(23), w)] for w in range(5)]
    light, fours = np.array([e for w in errors[:4] for e in w]), np.array(errors[4])
    leader = np.zeros(1 << 11, dtype=np.int64)
    leader[_syndromes(light)] = light
    at = _syndromes(fours)
    order = np.argsort(at, kind="stable")
    return leader, np.split(fours[order], np.searchsorted(at[order], np.arange(1, 1 << 11)))


def anchors_within(half: np.ndarray, excess: int) -> tuple[np.ndarray, np.ndarray]:
    """(index into half, anchor): the anchors a 32-bit half is replicated to; the first len(half) are the homes.

    Anchors are the words whose low 23 bits are a codeword of the perfect code (covering radius 3); the
    other 9 bits are free, so the radius of the whole half is 3. Every half within ``excess`` (0 or 1) bits
    of x has its home among the anchors within 3 + excess of x: the home of x, the other codewords at
    distance 4 of its low bits, and the home with one of the 9 free bits changed.
    """
    low, high = half & 0x7FFFFF, half >> 23
    leader, fours = _cosets()
    syndromes = _syndromes(low)
    home = low ^ leader[syndromes]
    index, anchor = [np.arange(len(half))], [(high << 23) | home]
    if excess:
        # Codewords at distance 4: only words at distance 3 from home can have them within reach of one bit,
        # the others keep their home when one bit changes.
        n = np.array([len(f) for f in fours])[syndromes]
        n = np.where(np.bitwise_count(leader[syndromes]) == 3, n, 0)
        index.append(np.repeat(np.arange(len(half)), n))
        errors = np.concatenate([np.zeros(0, np.int64), *[fours[s] for s, m in zip(syndromes.tolist(), n.tolist(), strict=True) if m]])
        anchor.append((high[index[-1]] << 23) | (low[index[-1]] ^ errors))
        for bit in range(9):
            index.append(np.arange(len(half)))
            anchor.append(((high ^ (1 << bit)) << 23) | home)
    return np.concatenate(index), np.concatenate(anchor)


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for i in range(0, whole.num_rows, 1 << 14):
            fp = np.asarray(whole.column("fp").slice(i, 1 << 14)).view(np.uint64)
            for side in (0, 1):
                half = ((fp >> np.uint64(32 * side)) & np.uint64(0xFFFFFFFF)).astype(np.int64)
                index, anchor = anchors_within(half, 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(anchor * 2 + side),
                        pa.array(fp[index].view(np.int64)),
                        pa.array(np.arange(len(index)) < len(half)),
                    ],
                    names=["anchor", "fp", "home"],
                )


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index in the component of each of n nodes, for edges a-b."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


def _links(threshold: int, step: int = 1 << 22):
    """Per (anchor, part): compares homes with replicas, returns a spanning star per component found."""

    def compare(home: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found: list[tuple[np.ndarray, np.ndarray]] = []
        rows = max(1, step // max(1, len(home)))
        for i in range(0, len(other), rows):
            far = np.bitwise_count(other[i : i + rows, None] ^ home[None, :])
            x, y = np.nonzero(far <= threshold)
            x, y = other[i + x], home[y]
            keep = x != y
            found.append((x[keep], y[keep]))
        x, y = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        nodes, at = np.unique(np.concatenate([x, y]), return_inverse=True)
        root = _roots(len(nodes), at[: len(x)], at[len(x) :])
        leaf = root != np.arange(len(nodes))
        return nodes[leaf], nodes[root[leaf]]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted by (anchor, part), homes first. Homes of one part are bounded; replicas stream by.
        key, homes = None, np.zeros(0, np.uint64)
        for batch in batches:
            anchor, part = np.asarray(batch.column("anchor")), np.asarray(batch.column("part"))
            fp = np.asarray(batch.column("fp")).view(np.uint64)
            is_home = np.asarray(batch.column("home").cast(pa.int8())).astype(bool)
            cuts = np.flatnonzero((anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])) + 1
            begin, end = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(fp)]])
            n_home = np.add.reduceat(is_home, begin) if len(fp) else begin
            out: list[tuple[np.ndarray, np.ndarray]] = []
            # Most groups are one home with few replicas, or none: all groups of one home are done at once.
            for g in np.flatnonzero((n_home > 1) | (np.arange(len(begin)) == 0) | (np.arange(len(begin)) == len(begin) - 1)):
                a, b = begin[g], end[g]
                now = (anchor[a], part[a])
                if now != key:
                    key, homes = now, np.zeros(0, np.uint64)
                homes = np.concatenate([homes, fp[a : a + n_home[g]]])
                others = fp[a + n_home[g] : b]
                if len(homes):
                    if n_home[g] > 1:
                        out.append(compare(homes, homes[-n_home[g] :]))
                    elif n_home[g] == 1 and len(homes) > 1:
                        out.append(compare(homes, homes[-1:]))
                    if len(others):
                        out.append(compare(homes, others))
            simple = np.zeros(len(begin), dtype=bool)
            simple[1:-1] = n_home[1:-1] == 1
            of = np.repeat(np.where(simple, np.arange(len(begin)), -1), end - begin)
            rows = np.flatnonzero((of >= 0) & ~is_home)
            x, y = fp[rows], fp[begin[of[rows]]]
            near = (np.bitwise_count(x ^ y) <= threshold) & (x != y)
            out.append((x[near], y[near]))
            a, b = np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return work


def near_links(fps: DataFrame, threshold: int = THRESHOLD, homes: int = HOMES) -> DataFrame:
    """Links (a, b) between distinct fingerprints at ``threshold`` (3 at most) or fewer differing bits.

    Not every close pair is a row: the links found at one anchor come as a star per connected part, so the
    links connect exactly what the pairs connect, and a large group gives as many rows as it has members.

    The code covers each 32-bit half with radius 3. Of two fingerprints at 3 bits or fewer one half
    differs by 1 bit or none, so replicating each half to every anchor within 3 + 1 brings both to the
    home of either. Anchors at home to more than ``homes`` fingerprints are split: homes into parts,
    replicas copied to each part, so a task holds ``homes`` fingerprints at a time and streams the others.
    """
    if threshold > 3:
        raise ValueError("two halves with one bit of excess each find pairs at 3 bits or fewer")
    rows = fps.select("fp").distinct().mapInArrow(_replicate, "anchor long, fp long, home boolean")
    rows = saved(rows)
    large = rows.filter("home").groupBy("anchor").count().filter(F.col("count") > homes)
    large = saved(large.select("anchor", F.ceil(F.col("count") / homes).cast("int").alias("parts")))
    if large.isEmpty():
        rows = rows.withColumn("part", F.lit(0))
    else:
        rows = rows.join(large, "anchor", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        own = F.array(F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        every = F.sequence(F.lit(0), F.col("parts") - 1)
        # Homes of the other parts are replicas here.
        home = rows.filter("home").select("anchor", "fp", "home", F.explode(own).alias("part"))
        rest = rows.filter(~F.col("home") | (F.col("parts") > 1)).select(
            "anchor", "fp", F.lit(False).alias("home"), F.explode(every).alias("part")
        )
        rows = home.unionByName(rest)
    rows = rows.repartition("anchor", "part").sortWithinPartitions("anchor", "part", F.col("home").desc())
    return rows.select("anchor", "part", "fp", "home").mapInArrow(_links(threshold), "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id (smallest id reachable by links).

    Documents with one fingerprint are one class and travel as one row. Null text has fingerprint 0 and is
    linked like any other; a null id is never the smallest (a component of null ids has a null id);
    repeated rows are rows of one class. Empty input gives no rows. Other columns are not read.
    """
    fps = saved(fingerprints(docs, id_col, text_col).withColumnRenamed(id_col, "_id"))
    classes = saved(fps.groupBy("fp").agg(F.min("_id").alias("least")))
    grouped = components(saved(near_links(classes, threshold).distinct()))
    of = classes.join(grouped, classes["fp"] == grouped["node"], "left")
    of = of.select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = of.groupBy("root").agg(F.min("least").alias("component_id"))
    of = saved(of.join(least, "root").select("fp", "component_id"))
    digits: Column = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return fps.join(of, "fp").select(F.col("_id").alias(id_col), digits.alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """The documents that stay, with all columns: the one with the smallest id of each component.

    A component of null ids keeps all its rows; rows that share an id all stay if one of them does.
    """
    names = docs.columns
    docs = docs.toDF(*[f"_c{i}" for i in range(len(names))])  # no name of theirs can clash with ours
    own = f"_c{names.index(id_col)}"
    found = simhash_components(docs, own, f"_c{names.index(text_col)}", threshold)
    # Those that go, the smaller part, are all that has to be known.
    gone = found.groupBy(F.col(own).alias("_gone")).agg(F.max(F.col(own).eqNullSafe(F.col("component_id"))).alias("_stays"))
    gone = gone.filter("not _stays").select("_gone")
    return docs.join(saved(gone), F.col(own).eqNullSafe(F.col("_gone")), "left_anti").toDF(*names)
