"""Ranked lexical search: item tiles times document tiles in float64, exact, with tie-safe best lists."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordloom.llm.terms import term_pack
from recordloom.llm.text_arrays import raw_bytes, slices
from recordloom.operators.shared import saved

BEST = 10
#: Terms (with repeats over items) of the items that one pass over the documents ranks; an item with more has its own pass.
BLOCK_TERMS = 1 << 20
#: Cells of a dense item tile and of a dense document tile, 8 bytes each.
ITEM_CELLS = 1 << 21
DOC_CELLS = 1 << 21
#: An impact is below this: (10^9 tf) div (1000 tf + 8 m) with m at least 10.
IMPACT = 1_000_000
EXACT = 1 << 53


@dataclass
class Vocabulary:
    """Terms in the order of their hashes, their bytes one after the other."""

    hashes: np.ndarray
    data: np.ndarray
    offsets: np.ndarray

    @staticmethod
    def of(terms: list[bytes]) -> tuple[Vocabulary, np.ndarray]:
        """The vocabulary of distinct terms, and the place in it of each."""
        words = term_pack(pa.array(terms, pa.large_binary()))
        hashes = words.hash(words.starts, words.ends)
        order = np.argsort(hashes, kind="stable")
        data, offsets = raw_bytes(pa.array([terms[i] for i in order], pa.large_binary()))
        place = np.empty(len(terms), dtype=np.int64)
        place[order] = np.arange(len(terms))
        return Vocabulary(hashes[order], data, offsets), place

    def find(self, words) -> tuple[np.ndarray, np.ndarray]:
        """(word, term): the words of a pack that are terms; bytes are compared, not hashes alone."""
        n = len(self.hashes)
        hashes = words.hash(words.starts, words.ends)
        at = np.searchsorted(self.hashes, hashes)
        found = []
        word = np.arange(len(at))
        while True:  # more than once only where terms share a hash
            open_ = at < n
            open_[open_] = self.hashes[at[open_]] == hashes[open_]
            word, at, hashes = word[open_], at[open_], hashes[open_]
            if not len(word):
                break
            begin, length = words.starts[word], words.ends[word] - words.starts[word]
            same = length == self.offsets[at + 1] - self.offsets[at]
            w, a, size = begin[same], self.offsets[at[same]], length[same]
            before = np.concatenate([[0], np.cumsum(size)])
            inside = np.arange(before[-1]) - np.repeat(before[:-1], size)
            equal = words.data[np.repeat(w, size) + inside] == self.data[np.repeat(a, size) + inside]
            wrong = np.repeat(np.arange(len(size)), size)[~equal]
            hit = np.ones(len(size), dtype=bool)
            hit[wrong] = False
            found.append((word[same][hit], at[same][hit]))
            at = at + 1
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


@dataclass
class Tile:
    """Some items and the terms that occur in them: cell (row, col) of the dense tile has the weight."""

    items: np.ndarray
    terms: np.ndarray
    row: np.ndarray
    col: np.ndarray

    def dense(self, weights: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.items), len(self.terms)))
        out[self.row, self.col] = weights[self.terms[self.col]]
        return out


def item_tiles(terms_of: list[np.ndarray], cells: int = ITEM_CELLS) -> list[Tile]:
    """Tiles of at most ``cells`` cells, or of one item; items without terms are in none."""
    tiles: list[Tile] = []
    part: list[int] = []
    known: set[int] = set()

    def close() -> None:
        if part:
            terms = np.unique(np.concatenate([terms_of[i] for i in part]))
            row = np.repeat(np.arange(len(part)), [len(terms_of[i]) for i in part])
            col = np.searchsorted(terms, np.concatenate([terms_of[i] for i in part]))
            tiles.append(Tile(np.array(part), terms, row, col))

    for i, terms in enumerate(terms_of):
        if not len(terms):
            continue
        more = known | set(terms.tolist())
        if part and (len(part) + 1) * len(more) > cells:
            close()
            part, more = [], set(terms.tolist())
        part, known = [*part, i], more
    close()
    return tiles


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "_text"):
        words = term_pack(batch.column("_text"))
        text = words.text()
        spans = [text[a:b] for a, b in zip(words.starts.tolist(), words.ends.tolist(), strict=True)]
        terms = [sorted(set(spans[a:b])) for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("_item"), pa.array(terms, pa.list_(pa.binary()))], names=["_item", "_terms"])


def _blocks(rows, limit: int) -> Iterator[tuple[list[int], list[list[bytes]]]]:
    """Items and their terms, in blocks of at most ``limit`` terms or one item."""
    ids: list[int] = []
    terms: list[list[bytes]] = []
    held = 0
    for row in rows:
        if ids and held + len(row["_terms"]) > limit:
            yield ids, terms
            ids, terms, held = [], [], 0
        ids.append(row["_item"])
        terms.append([bytes(t) for t in row["_terms"]])
        held += len(row["_terms"])
    if ids:
        yield ids, terms


def _vectors(vocabulary):
    """Per document: its number of terms, and the terms of the items in it with their occurrences."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        width = max(1, len(known.hashes))
        for batch in slices(batches, "_text"):
            words = term_pack(batch.column("_text"))
            word, term = known.find(words)
            cell, tf = np.unique(words.row[word] * width + term, return_counts=True)
            upto = np.searchsorted(cell, np.arange(batch.num_rows + 1) * width).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_id"),
                    pa.array(words.n_words.astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(upto), pa.array((cell % width).astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array(upto), pa.array(tf.astype(np.int32))),
                ],
                names=["_id", "_n", "_terms", "_tf"],
            )

    return work


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, documents that hold it): summed over the task before anything is sent."""
    count = np.zeros(0, dtype=np.int64)
    for batch in batches:
        now = np.bincount(np.asarray(batch.column("_terms").flatten()))
        if len(now) > len(count):
            count = np.concatenate([count, np.zeros(len(now) - len(count), np.int64)])
        count[: len(now)] += now
    term = np.flatnonzero(count)
    yield pa.RecordBatch.from_arrays([pa.array(term.astype(np.int32)), pa.array(count[term])], names=["term", "df"])


def _lengths(n: np.ndarray, documents: int, occurrences: int) -> np.ndarray:
    """10 + (90 n N) div L; in Python's whole numbers where 64 bits could not hold the product."""
    if not len(n) or int(n.max()) * 90 * documents < 1 << 62:
        return 10 + (90 * n * documents) // max(1, occurrences)
    return np.array([10 + (90 * k * documents) // occurrences for k in n.tolist()], dtype=np.int64)


@dataclass
class Best:
    """The best documents of each item so far: highest score first, then smallest id, null ids last."""

    k: int
    item: np.ndarray
    score: np.ndarray
    doc: np.ndarray
    null: np.ndarray

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        item, score = np.concatenate([self.item, item]), np.concatenate([self.score, score])
        doc, null = np.concatenate([self.doc, doc]), np.concatenate([self.null, null])
        order = np.lexsort((doc, null, -score, item))
        item = item[order]
        nth = np.arange(len(item)) - np.searchsorted(item, item)
        order = order[nth < self.k]
        self.item, self.score, self.doc, self.null = item[nth < self.k], score[order], doc[order], null[order]

    def floor(self, n_items: int) -> np.ndarray:
        """What a score must reach to enter the list of each item: 1, or the last score of a full list."""
        out = np.ones(n_items, dtype=np.int64)
        full = np.bincount(self.item, minlength=n_items) >= self.k
        least = np.full(n_items, np.iinfo(np.int64).max)
        np.minimum.at(least, self.item, self.score)
        out[full] = least[full]
        return out


def tile_scores(weights: np.ndarray, impacts: np.ndarray) -> np.ndarray:
    """weights @ impacts, exact: columns are cut so that no partial sum can reach 2^53."""
    step = max(1, (EXACT - 1) // (max(1, int(weights.max(initial=0))) * IMPACT))
    out = np.zeros((weights.shape[0], impacts.shape[1]), dtype=np.int64)
    for i in range(0, weights.shape[1], step):
        out += (weights[:, i : i + step] @ impacts[i : i + step]).astype(np.int64)
    return out


def _ranked(block, n_items: int, documents: int, occurrences: int, k: int, doc_cells: int):
    """Scores document tiles against all item tiles of a block; the best of each item at the end of the task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, tiles = block.value
        dense = [t.dense(weights) for t in tiles]
        column = np.full(len(weights), -1, dtype=np.int64)
        empty = np.zeros(0, np.int64)
        best = Best(k, empty, empty, empty, np.zeros(0, bool))
        widest = max((len(t.terms) for t in tiles), default=1)
        step = max(1, doc_cells // widest)
        for batch in batches:
            for begin in range(0, batch.num_rows, step):
                part = batch.slice(begin, step)
                ids = part.column("_id")
                null = np.asarray(ids.is_null())
                doc = np.asarray(pc.fill_null(ids.cast(pa.int64()), 0))
                count = np.asarray(pc.list_value_length(part.column("_terms")), dtype=np.int64)
                row = np.repeat(np.arange(part.num_rows), count)
                term = np.asarray(part.column("_terms").flatten()).astype(np.int64)
                tf = np.asarray(part.column("_tf").flatten()).astype(np.int64)
                m = _lengths(np.asarray(part.column("_n")), documents, occurrences)
                impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[row])
                for tile, w in zip(tiles, dense, strict=True):
                    column[tile.terms] = np.arange(len(tile.terms))
                    col = column[term]
                    column[tile.terms] = -1
                    own = col >= 0
                    impacts = np.zeros((len(tile.terms), part.num_rows))
                    impacts[col[own], row[own]] = impact[own]
                    scores = tile_scores(w, impacts)
                    floor = best.floor(n_items)[tile.items]
                    if part.num_rows > k:
                        # All that tie with the k-th of the tile stay, so the ids can decide.
                        floor = np.maximum(floor, np.partition(scores, -k, axis=1)[:, -k])
                    i, d = np.nonzero(scores >= floor[:, None])
                    best.add(tile.items[i], scores[i, d], doc[d], null[d])
        yield pa.RecordBatch.from_arrays(
            [pa.array(best.item), pa.array(best.doc, mask=best.null), pa.array(best.score)], names=["_at", "_id", "score"]
        )

    return work


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = BEST,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    block_terms: int = BLOCK_TERMS,
    item_cells: int = ITEM_CELLS,
    doc_cells: int = DOC_CELLS,
) -> DataFrame:
    """The ``k`` best documents of each item: item id, rank, document id, score.

    One pass over the texts turns each document into a short vector: how often it holds each term of the
    items. Documents and occurrences are counted over all of them. A second pass over the vectors builds
    dense tiles, the weights of some items over the terms that occur in them and the impacts of some
    documents over the same terms, and multiplies them. All figures are whole numbers and the columns
    are cut so that no partial sum reaches 2^53, so float64 is exact in any order of addition. Each task
    keeps the ``k`` best per item, ties by id, and only these are shuffled.

    The items are the query set: they pass through the driver in blocks of at most ``block_terms`` terms
    (or one item), and each block is one round over the documents, so there is no limit on their number.

    Document ids are whole numbers; null ids come after all others. Null and empty texts have no terms:
    such documents are never returned, such items have no rows. Every row of items is an item, also when
    it repeats another one; repeated documents are documents of their own. Without documents or items
    there are no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    asked = items.select(F.col(item_id_col).alias("_name"), F.col(item_text_col).alias("_text"))
    asked = saved(asked.withColumn("_item", F.monotonically_increasing_id()))
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    found = spark.createDataFrame([], "_item long, rank int, _id long, score long")
    listed = saved(asked.select("_item", "_text").mapInArrow(_item_terms, "_item long, _terms array<binary>"))
    for names, terms in _blocks(listed.orderBy("_item").toLocalIterator(), block_terms):
        distinct = sorted({t for own in terms for t in own})
        if not distinct:
            continue
        vocabulary, place = Vocabulary.of(distinct)
        at = dict(zip(distinct, place.tolist(), strict=True))
        terms_of = [np.array([at[t] for t in own], dtype=np.int64) for own in terms]
        sent = spark.sparkContext.broadcast(vocabulary)
        vectors = saved(texts.mapInArrow(_vectors(sent), "_id long, _n long, _terms array<int>, _tf array<int>"))
        documents, occurrences = vectors.agg(F.count_if(F.col("_n") > 0), F.coalesce(F.sum("_n"), F.lit(0))).first()
        df = np.zeros(len(distinct), dtype=np.int64)
        held = vectors.filter(F.size("_terms") > 0)
        counts = held.select("_terms").mapInArrow(_term_counts, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
        for row in counts.collect():  # one row per term of the block
            df[row["term"]] = row["df"]
        weights = [math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for n in df.tolist()]
        block = spark.sparkContext.broadcast((np.array(weights, dtype=np.float64), item_tiles(terms_of, item_cells)))
        work = _ranked(block, len(names), documents, occurrences, k, doc_cells)
        best = held.mapInArrow(work, "_at long, _id long, score long")
        order = Window.partitionBy("_at").orderBy(F.col("score").desc(), F.col("_id").asc_nulls_last())
        best = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        of = spark.createDataFrame(list(enumerate(names)), "_at long, _item long")
        found = found.unionByName(saved(best.join(F.broadcast(of), "_at").select("_item", "rank", "_id", "score")))
    return found.join(asked.select("_item", "_name"), "_item").select(
        F.col("_name").alias(item_id_col), "rank", F.col("_id").alias(id_col), "score"
    )
