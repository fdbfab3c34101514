"""Language-model scoring by logistic mixing of hashed-context bit predictors.

Texts are coded word by word (``lm_words``), by predictors whose contexts run across words; what follows here
spells words without a code and runs both over documents.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm import lm_words
from recordloom.llm.text_arrays import Pack, scramble, slices
from recordloom.operators.shared import saved

#: Bits of the table of each predictor of spelling: no context, one to four bytes, the word so far.
TABLE_BITS = (8, 16, 20, 20, 20, 20)
#: Words with a code of their own at most; all others are announced by one symbol, then counted or spelled.
CODED = 1 << 11
#: Training tokens that one task learns the mixing of coded words from, at least where there are many.
TASK_TOKENS = 1 << 23
#: Words whose figures every task holds, of so many bytes at most; all others are joined.
FREQUENT = 1 << 18
FREQUENT_BYTES = 64
#: Words that one run of fitting the mixing weights learns from, about; there are as many runs as all words need.
SAMPLE = 1 << 15
#: Groups of tasks whose counts are added up first.
PARTS = 64
#: Bytes of text whose words are counted together.
COUNT_BYTES = 16 << 20
#: Bytes of text that are scored at once: words that stand after the same words are predicted once.
SCORE_BYTES = 2 << 20
#: Bytes of words whose bits are worked on at once; of a longer single word only the contexts are formed at once.
SPELL_BYTES = 1 << 17
_BLOCK = 1 << 16
_K = len(TABLE_BITS)
_END = 0x20
_GATES = 64
_STEPS = 33
#: Predictions are no surer than one in ten million.
_FARTHEST = float(np.log((1 - 1e-7) / 1e-7))


def in_training(doc_id: Column, parts: int = 10) -> Column:
    """Whether crc32 of the id as text is no multiple of ``parts``; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % parts) != 0


# -- bits and their contexts ---------------------------------------------------------------------------


def _symbols(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words' bytes, each word with an end symbol; where each word begins; the contexts of each byte."""
    data = np.frombuffer(b" ".join(words) + b" ", dtype=np.uint8)
    ends = np.flatnonzero(data == _END)
    starts = np.concatenate([[0], ends[:-1] + 1])
    first = np.repeat(starts, ends - starts + 1)
    at = np.arange(len(data))
    contexts = np.zeros((_K, len(data)), dtype=np.uint64)
    past = np.zeros(len(data), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(1, _K - 1):
            # Bytes before the word count as one symbol, so contexts end at its start.
            back = at - k
            byte = np.where(back >= first, data[np.maximum(back, 0)].astype(np.uint64) + np.uint64(1), np.uint64(0))
            past = past * np.uint64(257) + byte
            contexts[k] = past + np.uint64(k << 48)
        contexts[_K - 1] = Pack(data, starts, ends, np.array([0, len(starts)])).hash(first, at)
    return data, starts, contexts


def _runs(words: list[bytes], limit: int) -> Iterator[tuple[int, int]]:
    """Runs of words of at most ``limit`` words and SPELL_BYTES bytes, or of one word."""
    total, begin = np.cumsum([0, *(len(w) + 1 for w in words)]), 0
    while begin < len(words):
        end = max(begin + 1, min(begin + limit, int(np.searchsorted(total, total[begin] + SPELL_BYTES, side="right")) - 1))
        yield begin, end
        begin = end


def _slots(data: np.ndarray, contexts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each of the 8 bits of the bytes: the slot per predictor, and the bit."""
    salted = scramble(contexts)
    for bit in range(7, -1, -1):
        node = (np.uint64(1) << np.uint64(7 - bit)) | (data >> np.uint8(bit + 1)).astype(np.uint64)
        slots = np.empty(contexts.shape, dtype=np.int64)
        slots[0] = node
        with np.errstate(over="ignore"):
            node *= np.uint64(0x9E3779B97F4A7C15)
            for k in range(1, _K):
                mixed = salted[k] ^ node
                mixed *= np.uint64(0xD6E8FEB86659FD93)
                np.right_shift(mixed, np.uint64(64 - TABLE_BITS[k]), out=slots[k].view(np.uint64))
        yield slots, (data >> np.uint8(bit)) & 1


def empty_tables() -> list[np.ndarray]:
    """Per predictor and slot the number of bits seen, and of ones among them, side by side: one look-up reads both."""
    return [np.zeros((1 << bits, 2), dtype=np.float64) for bits in TABLE_BITS]


def _distinct(data: np.ndarray, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes and contexts of each beginning of a word once, and which of them each byte is: what words begin
    with alike is predicted alike."""
    with np.errstate(over="ignore"):
        key = contexts[_K - 1] + (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    _, first, which = np.unique(key, return_index=True, return_inverse=True)
    return data[first], contexts[:, first], which


def _pairs(tables: list[np.ndarray]) -> list[np.ndarray]:
    """Both counts of a slot as one number of twice the size: one look-up reaches both."""
    return [t.view(f"c{2 * t.itemsize}").reshape(-1) for t in tables]


def count_bits(tables: list[np.ndarray], words: list[bytes], weight: np.ndarray) -> None:
    pairs = _pairs(tables)
    for begin, end in _runs(words, len(words)):
        data, starts, contexts = _symbols(words[begin:end])
        times = np.repeat(weight[begin:end].astype(np.float64), np.diff(np.append(starts, len(data))))
        data, contexts, which = _distinct(data, contexts)
        times = np.bincount(which, times)
        for i in range(0, len(data), SPELL_BYTES):
            part = times[i : i + SPELL_BYTES]
            for slots, bit in _slots(data[i : i + SPELL_BYTES], contexts[:, i : i + SPELL_BYTES]):
                both = part + 1j * (part * bit)
                for table, slot in zip(pairs, slots, strict=True):
                    # Few of the slots are met: only these are written to.
                    np.add.at(table, slot, both)


# -- mixing --------------------------------------------------------------------------------------------


@dataclass
class Model:
    """Counts per slot, mixing weights per gate, the last adaptive map from (gate, p) to p, and the bits that
    each gate was fitted on."""

    tables: list[np.ndarray]
    weights: np.ndarray
    refined: np.ndarray
    seen: np.ndarray


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _inputs(tables: list[np.ndarray], slots: np.ndarray, own: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Stretched predictions (one per predictor, and a bias) and the gate of each bit.

    The gate tells how often the word so far and the last three bytes were seen, so it decides how far the
    longer contexts are trusted. ``own`` is the bit itself: it is taken out of the counts once, so that
    weights are fitted on words the tables have not seen.
    """
    out, level = np.empty((_K + 1, slots.shape[1]), np.float32), {}
    out[_K] = 0.3
    for k, (pairs, slot) in enumerate(zip(_pairs(tables), slots, strict=True)):
        both = pairs.take(slot)
        n, ones = both.real.astype(np.float32), both.imag.astype(np.float32)
        if own is not None:
            n, ones = np.maximum(n - 1, 0), np.maximum(ones - own, 0)
        if k in (_K - 1, 3):
            level[k] = np.minimum((n + 1).view(np.int32) >> 23, 127 + 7).astype(np.int64) - 127
        # The stretched chance (ones + 0.05) / (n + 0.1) is the logarithm of ones to zeros.
        n -= ones
        n += np.float32(0.05)
        ones += np.float32(0.05)
        ones /= n
        np.clip(np.log(ones, out=ones), -_FARTHEST, _FARTHEST, out=out[k])
    return out, level[_K - 1] * 8 + level[3]


def _mixed(weights: np.ndarray, inputs: np.ndarray, gate: np.ndarray) -> np.ndarray:
    """The inputs joined by the weights of each bit's gate."""
    x = np.zeros(len(gate), np.float32)
    for of_input, column in zip(np.ascontiguousarray(weights.T, np.float32), inputs, strict=True):
        x += of_input.take(gate) * column
    return x


def _refine(refined: np.ndarray, gate: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    place = (np.clip(x, -8, 8) + 8) * ((_STEPS - 1) / 16)
    low = np.minimum(place.astype(np.int64), _STEPS - 2)
    share, cell = place - low, gate * _STEPS + low
    below = refined.take(cell)
    return below + (refined.take(cell + 1) - below) * share, cell, share


def _predict(model: Model, inputs: np.ndarray, gate: np.ndarray) -> np.ndarray:
    """The chance that the bit is 1: mixed by the gate's weights, then averaged with its refined value."""
    x = _mixed(model.weights, inputs, gate)
    return np.clip((_squash(x) + _refine(model.refined, gate, x)[0]) / 2, 1e-9, 1 - 1e-9)


def fit_mixer(tables: list[np.ndarray], words: list[bytes], passes: int = 2, step: int = 256, rate: float = 0.05) -> Model:
    """Learns weights and refinement online: short runs of words in turn, errors of each step the next.

    Steps of a weight shrink with the squares of its past ones.
    """
    start = np.full((_GATES, _K + 1), 1.0 / _K)
    start[:, _K] = 0
    grid = _squash((np.arange(_STEPS) - (_STEPS - 1) / 2) * 16 / (_STEPS - 1))
    model = Model(tables, start, np.repeat(grid[None, :], _GATES, axis=0), np.zeros(_GATES))
    squares = np.full_like(start, 1e-2)
    for _ in range(passes):
        for begin, end in _runs(words, step):
            data, _, contexts = _symbols(words[begin:end])
            for i in range(0, len(data), SPELL_BYTES):
                steps = list(_slots(data[i : i + SPELL_BYTES], contexts[:, i : i + SPELL_BYTES]))
                # The tables stay as they are: all eight bits are looked up at once, and learned in turn.
                every = _inputs(tables, np.concatenate([s for s, _ in steps], axis=1), np.concatenate([b for _, b in steps]))
                for j, (_, bit) in enumerate(steps):
                    now = slice(j * len(bit), (j + 1) * len(bit))
                    inputs, gate = every[0][:, now], every[1][now]
                    x = _mixed(model.weights, inputs, gate)
                    error = (bit - _squash(x)) * inputs
                    change = np.stack([np.bincount(gate, weights=e, minlength=_GATES) for e in error], axis=1)
                    squares += change * change
                    model.weights += rate * change / np.sqrt(squares)
                    guess, cell, share = _refine(model.refined, gate, x)
                    miss = (bit - guess) * 0.02
                    up = miss * share
                    moved = np.bincount(cell, weights=miss - up, minlength=_GATES * _STEPS)
                    moved += np.bincount(cell + 1, weights=up, minlength=_GATES * _STEPS)
                    model.refined += moved.reshape(_GATES, _STEPS)
                    np.clip(model.refined, 1e-6, 1 - 1e-6, out=model.refined)
                    model.seen += np.bincount(gate, minlength=_GATES)
    return model


def log10_words(model: Model, words: list[bytes]) -> np.ndarray:
    """log10 of the chance of each word: of its bytes and its end, bit by bit. The empty word ends a text."""
    out = np.zeros(len(words))
    for begin, end in _runs(words, 1 << 12):
        data, starts, contexts = _symbols(words[begin:end])
        data, contexts, which = _distinct(data, contexts)
        total = np.zeros(len(data))
        for i in range(0, len(data), SPELL_BYTES):
            for slots, bit in _slots(data[i : i + SPELL_BYTES], contexts[:, i : i + SPELL_BYTES]):
                p = _predict(model, *_inputs(model.tables, slots, None))
                total[i : i + SPELL_BYTES] += np.log10(np.where(bit == 1, p, 1 - p))
        out[begin:end] = np.add.reduceat(total[which], starts)
    return out


# -- over documents ------------------------------------------------------------------------------------


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, ASCII letters lowered, and how many each text has; null counts as empty."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = parts.flatten().cast(pa.binary())
    # Blanks at an end of a text leave an empty part there.
    real = pc.greater(pc.binary_length(words), 0)
    before = np.concatenate([[0], np.cumsum(np.asarray(real))])
    ends = np.cumsum(np.asarray(pc.list_value_length(parts)))
    return words.filter(real), np.diff(before[ends], prepend=0)


def _symbols_of(texts: pa.Array, place: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """The symbols of all texts, each with its end; where each text begins; the words, and where they stand.

    ``place`` lists the words that have a symbol, in order of these; any other word is ``OTHER``.
    """
    words, n = _words(texts)
    begin = np.cumsum(n + 1) - n - 1
    at = np.arange(len(words)) + np.repeat(np.arange(len(n)), n)
    found = np.asarray(pc.fill_null(pc.index_in(words, value_set=place), -1))
    symbols = np.full(len(words) + len(n), lm_words.END, np.int64)
    symbols[at] = np.where(found < 0, lm_words.OTHER, found + lm_words.WORDS)
    return symbols, begin, words, at


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, c, n): how often each word stands in the training documents, and in all."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> Iterator[pa.RecordBatch]:
            for learned, words in met.items():
                found = pa.chunked_array(words, pa.binary()).value_counts()
                n = found.field("counts")
                yield pa.RecordBatch.from_arrays([found.field("values"), n if learned else pa.array(np.zeros(len(n), np.int64)), n], names=["word", "c", "n"])

        met, size = {True: [], False: []}, 0
        for batch in slices(batches, "_text"):
            for learned in met:
                texts = batch.filter(pc.equal(batch.column("_train"), learned)).column("_text")
                met[learned].append(_words(texts)[0])
                size += pc.sum(pc.binary_length(texts)).as_py() or 0
            if size > COUNT_BYTES:
                yield from flush()
                met, size = {True: [], False: []}, 0
        yield from flush()

    counted = rows.select("_text", "_train").mapInArrow(work, "word binary, c long, n long")
    return counted.groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def _blocks(tables: Iterable[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Tables of numbers cut into blocks, for ``_summed``."""
    group = TaskContext.get().partitionId() % PARTS
    for k, table in enumerate(tables):
        flat = table.reshape(-1)
        for block in range(0, len(flat), 2 * _BLOCK):
            blob = pa.compress(flat[block : block + 2 * _BLOCK].astype(np.float64).tobytes(), "zstd", asbytes=True)
            arrays = [pa.array([x], pa.int32()) for x in (k, block, group)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([blob], pa.binary())], names=["k", "block", "part", "counts"])


def _add_sorted(sizes: list[int]):
    """Adds up blobs of numbers that come sorted by (k, block): one sum is held at a time."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, np.zeros(0)

        def row() -> pa.RecordBatch:
            blob = pa.compress(total.tobytes(), "zstd", asbytes=True)
            arrays = [pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([key[2]], pa.int32()), pa.array([blob], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, names=["k", "block", "part", "counts"])

        for batch in batches:
            for k, block, part, blob in zip(*(batch.column(c).to_pylist() for c in ("k", "block", "part", "counts")), strict=True):
                n = min(2 * _BLOCK, sizes[k] - block) * 8
                now = np.frombuffer(pa.decompress(blob, n, "zstd", asbytes=True))
                if (k, block, part) != key:
                    if key is not None:
                        yield row()
                    key, total = (k, block, part), now.copy()
                else:
                    total += now
        if key is not None:
            yield row()

    return work


_BLOCK_SCHEMA = "k int, block int, part int, counts binary"


def _summed(blocks: DataFrame, sizes: list[int], dtype: type) -> list[np.ndarray]:
    """The sums over tasks of tables of so many numbers; the tables are of a bounded size.

    Tasks are many at scale, so their blobs are added in two steps: first those of each of PARTS groups of tasks.
    """
    for key in (["k", "block", "part"], ["k", "block"]):
        if len(key) == 2:
            blocks = blocks.withColumn("part", F.lit(0))
        blocks = blocks.repartition(*key).sortWithinPartitions(*key).mapInArrow(_add_sorted(sizes), _BLOCK_SCHEMA)
    tables = [np.zeros(n, dtype) for n in sizes]
    for row in blocks.toLocalIterator():  # rows of 1 MB at most, as many at any size
        n = min(2 * _BLOCK, sizes[row["k"]] - row["block"])
        tables[row["k"]][row["block"] : row["block"] + n] = np.frombuffer(pa.decompress(row["counts"], n * 8, "zstd", asbytes=True))
    return tables


def _bit_tables(counts: DataFrame) -> list[np.ndarray]:
    """The tables of all training words: counted per task, added up per block of slots."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, any_ = empty_tables(), False
        for batch in batches:
            for i in range(0, batch.num_rows, 1 << 13):
                part = batch.slice(i, 1 << 13)
                count_bits(tables, part.column("word").to_pylist(), np.ones(part.num_rows))
                any_ = True
        yield from _blocks(tables if any_ else [])

    # In order, words that begin alike stand together.
    learned = counts.filter("c > 0").select("word").sortWithinPartitions("word").mapInArrow(count, _BLOCK_SCHEMA)
    return [t.reshape(-1, 2) for t in _summed(learned, [2 << bits for bits in TABLE_BITS], np.float32)]


def train(counts: DataFrame, sample: int = SAMPLE, passes: int = 2) -> Model:
    """The model of all words of training documents and of the end of a text, each counted once.

    Counting words, not their occurrences, fits the model to its use: it spells the words that a class has
    not seen. Weights are fitted on all these words, each taken out of the counts for itself: they are dealt
    by a hash into runs of about ``sample`` words, and gates are averaged over the runs by the bits they saw.
    """
    tables, end = _bit_tables(counts), empty_tables()
    count_bits(end, [b""], np.ones(1))
    tables = [t + e.astype(np.float32) for t, e in zip(tables, end, strict=True)]
    shared = counts.sparkSession.sparkContext.broadcast(tables)  # 34 MB at any size
    words = counts.filter("c > 0").select("word")
    n, size = words.agg(F.count("word"), F.coalesce(F.sum(F.octet_length("word")), F.lit(0))).first()
    runs = max(1, -(-n // sample), -(-size // (sample * FREQUENT_BYTES)))
    dealt = words.select("word", F.xxhash64("word").alias("_order"), F.pmod(F.xxhash64("word", F.lit("run")), F.lit(runs)).alias("_run"))

    def fit(table: pa.Table) -> pa.Table:
        found = fit_mixer(shared.value, table.sort_by([("_order", "ascending"), ("word", "ascending")]).column("word").to_pylist(), passes)
        sums = np.column_stack([found.seen, found.seen[:, None] * found.weights, found.seen[:, None] * found.refined])
        return pa.table({"sums": pa.array([sums.tobytes()], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            total = sum((np.frombuffer(b) for b in batch.column("sums").to_pylist()), total)
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    model = fit_mixer(tables, [])
    found = dealt.groupBy("_run").applyInArrow(fit, "sums binary").mapInArrow(add, "sums binary").collect()  # 21 KB per task
    if found:
        sums = sum(np.frombuffer(r["sums"]) for r in found).reshape(_GATES, -1)
        met = sums[:, 0] > 0
        model.seen[:] = sums[:, 0]
        model.weights[met] = sums[met, 1 : _K + 2] / sums[met, :1]
        model.refined[met] = sums[met, _K + 2 :] / sums[met, :1]
    return model


def _mixer(rows: DataFrame, code: lm_words.Code, place: pa.Array, tokens: int) -> lm_words.Mixer:
    """The model of coded words: each task makes one pass over its training documents; counts are added up, and
    weights averaged by the bits that each gate saw."""
    sent = rows.sparkSession.sparkContext.broadcast((code, place))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, place = sent.value
        learner = None
        for batch in slices(batches, "_text"):
            if batch.num_rows:
                learner = learner or lm_words.Learner(code)
                learner.learn(_symbols_of(batch.column("_text"), place)[0])
        if learner:
            # One table at a time: they are large.
            yield from _blocks(chain(map(lm_words.side_by_side, learner.counts), [learner.sums()]))

    # Every task sends its tables, so a task learns from many texts.
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-tokens // TASK_TOKENS))
    learned = rows.filter("_train").select("_text").coalesce(tasks).mapInArrow(learn, _BLOCK_SCHEMA)
    *counts, sums = _summed(learned, [*(2 << bits for bits in lm_words.TABLE_BITS), lm_words.SUMS], np.float64)
    return lm_words.Mixer(code, [c.reshape(-1, 2) for c in counts], sums)


def score(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    coded: int = CODED,
    frequent: int = FREQUENT,
    sample: int = SAMPLE,
) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    A text is its words, ASCII letters lowered, and an end. The base is a smoothed unigram model of the
    training documents. The score is the sum of the chances of all words and the end, each after the words
    before it. The ``coded`` most frequent training words, the end and "another word" are symbols of a prefix
    code; each bit of it is predicted from the code alone and from hashed contexts across words (the last
    word, the last two, the last very frequent one), joined by a logistic mixer whose weights a gate picks, and
    refined by an adaptive map (``lm_words``). Another word then has the chance of its number among these in
    training, with its spelling as the prior: mixed in the same way, from the last 0 to 4 bytes and the word
    so far. Spelling depends on the word alone, so each distinct word is spelled once.

    Counts and weights are learned from all training documents, one online pass per task; so the last digits
    of a score depend on how the input is dealt to tasks. Tables have a fixed size; hashes that collide share
    a slot, and a gate that tells how often a slot was met decides how far it is trusted.

    Figures of the ``frequent`` most frequent words (a bounded list) and of the coded ones are sent to the
    tasks; all other words of a document travel with their number and are joined to the table of words, so no
    list of all words is held anywhere and no frequent word makes a hot key. Words of more than 64 bytes have no
    code and are always joined.

    Null text is empty and has one token, its end. A null id counts as the empty text in the split. Repeated
    rows are documents of their own. Empty input gives no rows. With nothing to learn from, every count is 0.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("_id"), in_training(F.col(id_col)).alias("_train"), F.col(text_col).alias("_text"))
    counts = saved(word_counts(rows))
    n_ends = rows.filter("_train").count()
    known, total, once = counts.agg(F.count(F.when(F.col("c") > 0, True)), F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") == 1, True))).first()
    n = total + n_ends
    base = n + 0.1 * (known + (n_ends > 0) + 1)
    short = counts.filter(F.octet_length("word") <= FREQUENT_BYTES)
    kept = short.filter("c > 1").orderBy(F.desc("c"), "word").limit(coded).select("word", "c").toArrow()
    with_code = kept.column("c").to_numpy()
    # Both other symbols may follow anything: they count once more.
    code = lm_words.prefix_code(np.array([n_ends + 1, total - int(with_code.sum()) + 1, *with_code]))
    place = kept.column("word").combine_chunks()
    mixer = _mixer(rows, code, place, n)
    # The prior weighs as much as the words seen once.
    prior, others = max(float(once), 1.0), float(total - int(with_code.sum()))
    model = train(counts, sample, passes=1)
    shared = spark.sparkContext.broadcast(model)  # 34 MB at any size

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = log10_words(shared.value, batch.column("word").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*batch.schema.names, "spelled"])

    words = saved(counts.sortWithinPartitions("word").mapInArrow(spell, "word binary, c long, n long, spelled double"))
    top = words.filter(F.octet_length("word") <= FREQUENT_BYTES).orderBy(F.desc("n"), "word").limit(frequent).select("word", "c", "spelled").toArrow()
    more = top.filter(pc.invert(pc.is_in(top.column("word"), value_set=place)))
    n_coded = len(place) + lm_words.WORDS
    place = pa.concat_arrays([place, *more.column("word").chunks])
    c = np.concatenate([[n_ends, 0], with_code, more.column("c").to_numpy()]).astype(float)
    # The chance of a long word is below the smallest double: words new to training stay in logs.
    spelled = more.column("spelled").to_numpy()
    seen = c[n_coded:]
    blended = np.log10(np.where(seen > 0, seen + prior * np.power(10.0, spelled), 1.0))
    own = np.where(seen > 0, blended, np.log10(prior) + spelled) - np.log10(others + prior)
    # Per word: base, whether known, and its chance beside the symbol; words that are joined have their figures there.
    figures = np.stack([np.log10((c + 0.1) / base), c > 0, np.concatenate([np.zeros(n_coded), own])])
    figures[:, lm_words.OTHER] = 0
    sent = spark.sparkContext.broadcast((place, figures, n_coded, mixer))
    kind = rows.schema["_id"].dataType.simpleString()

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, figures, n_coded, mixer = sent.value
        for batch in slices(batches, "_text", SCORE_BYTES):
            if not batch.num_rows:
                continue
            symbols, begin, words, at = _symbols_of(batch.column("_text"), place)
            whole = np.stack([np.add.reduceat(f.take(symbols), begin) for f in figures])
            whole[2] += np.add.reduceat(mixer.log10_symbols(np.where(symbols < n_coded, symbols, lm_words.OTHER)), begin)
            size = np.diff(begin, append=len(symbols))
            length = np.zeros(len(symbols), np.int64)
            length[at] = np.asarray(pc.binary_length(words))
            # Words without figures, once per document.
            left = np.flatnonzero(symbols[at] == lm_words.OTHER)
            other = words.take(pa.array(left)).dictionary_encode()
            n_other = max(len(other.dictionary), 1)
            of = np.searchsorted(begin, at[left], side="right") - 1
            pair, times = np.unique(of * n_other + np.asarray(other.indices), return_counts=True)
            rows, extra, none = batch.column("_row").to_numpy(), len(pair), np.zeros(len(pair))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([rows, rows[pair // n_other]])),
                    # A blank is in no word, so these rows find none and spread evenly.
                    pa.concat_arrays([pa.array([f" {r}".encode() for r in rows], pa.binary()), other.dictionary.take(pa.array(pair % n_other))]),
                    pa.array(np.concatenate([np.zeros(len(rows), np.int64), times])),
                    pa.concat_arrays([batch.column("_id"), pa.nulls(extra, batch.column("_id").type)]),
                    pa.concat_arrays([batch.column("_train"), pa.nulls(extra, pa.bool_())]),
                    *[pa.array(np.concatenate([x, np.zeros(extra, np.int64)])) for x in (size, np.add.reduceat(length, begin) + size)],
                    *[pa.array(np.concatenate([x, none])) for x in whole],
                ],
                names=["_row", "word", "n", "_id", "_train", "n_tokens", "n_bytes", "base", "n_known", "score"],
            )

    schema = f"_row long, word binary, n long, _id {kind}, _train boolean, n_tokens long, n_bytes long, base double, n_known double, score double"
    parts = rows.withColumn("_row", F.monotonically_increasing_id()).mapInArrow(add_up, schema)
    parts = parts.join(words.select("word", "c", "spelled"), "word", "left")
    found = F.col("c").isNotNull()

    def plus(column: str, more: Column) -> Column:
        return (F.col(column) + F.when(found, F.col("n") * more).otherwise(0.0)).alias(column)

    blended = F.log10(F.col("c") + prior * F.pow(F.lit(10.0), F.col("spelled")))
    own = F.when(F.col("c") > 0, blended).otherwise(F.col("spelled") + float(np.log10(prior))) - float(np.log10(others + prior))
    parts = parts.select(
        *["_row", "_id", "_train", "n_tokens", "n_bytes"],
        plus("n_known", (F.col("c") > 0).cast("int")),
        plus("base", F.log10((F.col("c") + 0.1) / F.lit(float(base)))),
        plus("score", own),
    )
    sums = [F.sum(c).alias(c) for c in ("n_tokens", "n_bytes", "n_known", "base", "score")]
    total_of = parts.groupBy("_row").agg(F.max("_id").alias("_id"), F.max("_train").alias("_train"), *sums)
    return total_of.select(
        F.col("_id").alias(id_col),
        (~F.col("_train")).alias("held_out"),
        "n_tokens",
        F.col("n_known").cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"),
        "score",
        (-F.col("score") * float(np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
