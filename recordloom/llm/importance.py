"""Importance resampling towards a target: hashed n-gram features, counted once per distinct line."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.llm.crc import run_sums
from recordloom.llm.terms import line_pack
from recordloom.llm.text_arrays import Pack, by_row, slices
from recordloom.operators.shared import saved

LONGEST = 3
BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 5
SEED = "42"


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines that have a word, as their words joined by one space."""
    for batch in slices(batches, "_text"):
        lines, _ = line_pack(batch.column("_text"))
        text = lines.text()
        begin, end = lines.starts[lines.first[:-1]], lines.ends[lines.first[1:] - 1]
        out = [text[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string())], names=["line"])


def _inner(lines: Pack, longest: int) -> list[np.ndarray]:
    """For each n, the first words of the runs of n words within one line."""
    return [lines.windows(n) for n in range(1, longest + 1)]


def _crossing(lines: Pack, texts: Pack, longest: int) -> list[np.ndarray]:
    """For each n, the first words of the runs within one text that go over the end of a line."""
    out = []
    for n in range(1, longest + 1):
        crosses = np.zeros(len(lines.starts), dtype=bool)
        crosses[texts.windows(n)] = True
        crosses[lines.windows(n)] = False
        out.append(np.flatnonzero(crosses))
    return out


def _texts(lines: Pack, text_of: np.ndarray, n: int) -> Pack:
    """The same words with one row per text."""
    return Pack(lines.data, lines.starts, lines.ends, lines.first[np.searchsorted(text_of, np.arange(n + 1))])


class _Counts:
    """Features per bucket, added up over a task."""

    def __init__(self, buckets: int) -> None:
        self.total = np.zeros(buckets, dtype=np.int64)

    def add(self, sums: np.ndarray, times: np.ndarray | None = None) -> None:
        bucket = (sums % len(self.total)).astype(np.int64)
        if times is None:
            self.total += np.bincount(bucket, minlength=len(self.total))
        else:
            np.add.at(self.total, bucket, times)

    def rows(self) -> pa.RecordBatch:
        some = np.flatnonzero(self.total)
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(self.total[some])], names=["bucket", "n"])


def _line_counts(buckets: int, longest: int):
    """Over distinct lines: the features of each, once, times its occurrences."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts(buckets)
        for batch in slices(batches, "line"):
            lines, row = line_pack(batch.column("line"))
            times = np.asarray(batch.column("times"))[row]
            for sums, begin in zip(run_sums(lines, longest), _inner(lines, longest), strict=True):
                counts.add(sums[begin], times[lines.row[begin]])
        yield counts.rows()

    return work


def _crossing_counts(buckets: int, longest: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts(buckets)
        for batch in slices(batches, "_text"):
            lines, text_of = line_pack(batch.column("_text"))
            texts = _texts(lines, text_of, batch.num_rows)
            for sums, begin in zip(run_sums(lines, longest), _crossing(lines, texts, longest), strict=True):
                counts.add(sums[begin])
        yield counts.rows()

    return work


def feature_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """(bucket, n) of all texts in column ``_text``.

    Newlines separate words, so a text is its lines one after the other. Equal lines shrink to one row with
    a number in the map tasks and after the shuffle, however often they stand; their features are worked
    out once. The runs that go over the end of a line are counted beside them, from the texts.
    """
    schema = "bucket int, n long"
    lines = texts.mapInArrow(_lines, "line string").groupBy("line").agg(F.count("*").alias("times"))
    inner = lines.mapInArrow(_line_counts(buckets, longest), schema)
    crossing = texts.mapInArrow(_crossing_counts(buckets, longest), schema)
    return inner.unionByName(crossing).groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket floor(1000 ln(smoothed share in the target / smoothed share in all documents))."""
    s_all, t_all, b = int(raw.sum()), int(target.sum()), len(raw)
    pairs = zip(raw.tolist(), target.tolist(), strict=True)
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + b) / ((s + 1) * (t_all + b)))) for s, t in pairs], dtype=np.int64)


def _first_of_equal(lines: Pack) -> np.ndarray:
    """For each line the place of the first equal line of the pack; bytes are compared under a hash."""
    begin, end = lines.starts[lines.first[:-1]], lines.ends[lines.first[1:] - 1]
    _, first, of = np.unique(lines.hash(begin, end), return_index=True, return_inverse=True)
    first = first[of]
    n = end - begin
    same = n == n[first]
    same[same] = lines.same(begin[same], begin[first[same]], n[same])
    return np.where(same, first, np.arange(len(first)))


def _weights(gain: np.ndarray, longest: int):
    """Per text its words, features and summed gains: distinct lines of a slice once, crossing runs beside them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            lines, text_of = line_pack(batch.column("_text"))
            texts = _texts(lines, text_of, batch.num_rows)
            if len(text_of):
                first = _first_of_equal(lines)
                distinct = np.flatnonzero(first == np.arange(len(first)))
                words = np.concatenate([[0], np.cumsum(lines.n_words[distinct])])
                pick = np.arange(words[-1]) + np.repeat(lines.first[distinct] - words[:-1], lines.n_words[distinct])
                once = Pack(lines.data, lines.starts[pick], lines.ends[pick], words)
                per_word = np.zeros(len(pick), dtype=np.int64)
                for sums, begin in zip(run_sums(once, longest), _inner(once, longest), strict=True):
                    per_word[begin] += gain[sums[begin] % len(gain)]
                of_line = np.zeros(len(first), dtype=np.int64)
                of_line[distinct] = by_row(once, per_word)
                of_line = of_line[first]
                upto = np.concatenate([[0], np.cumsum(of_line)])
                at = np.searchsorted(text_of, np.arange(batch.num_rows + 1))
                weight = upto[at[1:]] - upto[at[:-1]]
                over = np.zeros(len(lines.starts), dtype=np.int64)
                for sums, begin in zip(run_sums(lines, longest), _crossing(lines, texts, longest), strict=True):
                    over[begin] += gain[sums[begin] % len(gain)]
                weight = weight + by_row(texts, over)
            else:
                weight = np.zeros(batch.num_rows, dtype=np.int64)
            n = texts.n_words
            features = sum(np.maximum(n - k, 0) for k in range(longest))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), pa.array(n.astype(np.int64)), pa.array(features.astype(np.int64)), pa.array(weight)],
                names=["_id", "n_words", "n_features", "weight"],
            )

    return work


def _noise(doc_id: Column, seed: str) -> Column:
    """floor(1000 g) of the Gumbel variate g that the id and the seed give."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def _bucket_array(counts: DataFrame, buckets: int) -> np.ndarray:
    out = np.zeros(buckets, dtype=np.int64)
    for row in counts.collect():  # one row per bucket at most
        out[row["bucket"]] = row["n"]
    return out


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    seed: str = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
    buckets: int = BUCKETS,
    longest: int = LONGEST,
) -> DataFrame:
    """One row per document: id, n_features, weight, score, rank (null for those not drawn).

    A feature is a run of 1 to ``longest`` consecutive words, hashed to one of ``buckets``. The weight of a
    document is the sum of the gains of its features, the score adds Gumbel noise of its id, so the
    ``percent`` of the documents of ``min_words`` words and more with the highest scores are a draw without
    replacement by importance weight. Ranks come from one range sort: rows before a partition, from counts
    per partition, and place in it.

    Null and empty texts have no features and weight 0. A null id is hashed as no characters and comes last among
    equal scores; repeated rows are documents of their own, in any order among each other. An empty
    target has the same smoothed share in every bucket. Empty documents give no rows. Other columns are not read.
    """
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    raw = _bucket_array(feature_counts(texts.select("_text"), buckets, longest), buckets)
    wanted = _bucket_array(feature_counts(target.select(F.col(target_text_col).alias("_text")), buckets, longest), buckets)
    kind = texts.schema["_id"].dataType.simpleString()
    scored = texts.mapInArrow(_weights(gains(raw, wanted), longest), f"_id {kind}, n_words long, n_features long, weight long")
    scored = scored.withColumn("score", F.col("weight") + _noise(F.col("_id"), seed))
    scored = saved(scored.withColumn("_row", F.monotonically_increasing_id()))
    long_enough = scored.filter(F.col("n_words") >= min_words).select("_row", "_id", "score")
    n_drawn = percent * long_enough.count() // 100
    order = [F.col("score").desc(), F.col("_id").asc_nulls_last(), F.col("_row")]
    # A range sort; the id tells the partition (upper bits) and the place in it (lower 33 bits).
    ordered = saved(long_enough.orderBy(*order).select("_row", F.monotonically_increasing_id().alias("_at")))
    part = F.shiftright("_at", 33)
    sizes = ordered.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    before = F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = saved(sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before")))  # one row per partition
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    drawn = ordered.join(sizes, part == F.col("_part")).select(F.col("_row").alias("_of"), place.alias("rank"))
    drawn = saved(drawn.filter(F.col("rank") <= n_drawn))
    out = scored.join(drawn, F.col("_row") == F.col("_of"), "left")
    return out.select(F.col("_id").alias(id_col), "n_features", "weight", "score", "rank")


def draw(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents drawn, with all their columns; rows that share an id stay if one of them is drawn."""
    names = docs.columns
    docs = docs.toDF(*[f"_c{i}" for i in range(len(names))])  # no name of theirs can clash with ours
    own, text = f"_c{names.index(id_col)}", f"_c{names.index(options.pop('text_col', 'text'))}"
    found = resample(docs, target, id_col=own, text_col=text, **options).filter("rank is not null")
    kept = saved(found.select(F.col(own).alias("_kept")).distinct())
    return docs.join(kept, F.col(own).eqNullSafe(F.col("_kept")), "left_semi").toDF(*names)
