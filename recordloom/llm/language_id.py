"""Language identification by blended-spectrum string kernels, Nystroem landmarks and kernel ridge regression."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.llm.text_arrays import raw_bytes, slices
from recordloom.operators.shared import saved

#: Lengths (bytes) of the n-grams of the kernel, and bits of the hash of each length.
SPECTRUM = (2, 3, 4)
BITS = 14
#: Labelled rows per language that the regression is fitted on at most, and landmarks per language among them.
SAMPLE, LANDMARKS = 400, 64
#: Labelled rows of all languages together at most, 6 KB each on the driver, and languages that are learned at most
#: (the most frequent ones).
MAX_SAMPLE, MAX_LANGUAGES = 1 << 14, 1 << 11
#: Landmarks of all languages together at most (but one each): 100 MB on the driver.
MAX_LANDMARKS = 512
RIDGE = 1e-3
_LETTER = r"\p{L}"
_WIDTH = len(SPECTRUM) << BITS


def held_out(doc_id: Column, parts: int = 4, part: int = 2) -> Column:
    """Whether crc32 of the id as text leaves ``part``; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % parts) == part


def presence(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of 0 or 1 per text: which (hashed) n-grams occur in it, by length."""
    # ASCII letters are lowered; runs of other ASCII characters count as one blank, so junk adds no n-grams.
    letter = ((data >= 0x41) & (data <= 0x5A)) | ((data >= 0x61) & (data <= 0x7A)) | (data >= 0x80)
    data = np.where(letter, np.where(data < 0x80, data | 0x20, data), 0x20).astype(np.uint32)
    kept = letter.copy()
    kept[1:] |= letter[:-1]
    upto = np.concatenate([[0], np.cumsum(kept)])
    data, offsets = data[kept], upto[offsets]
    out = np.zeros((len(offsets) - 1, _WIDTH), dtype=np.uint8)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(data))
    with np.errstate(over="ignore"):
        code = np.zeros(len(data), dtype=np.uint32)
        for n in range(1, max(SPECTRUM) + 1):
            code = code[: max(0, len(data) - n + 1)] * np.uint32(257) + data[n - 1 :]
            if n in SPECTRUM:
                inside = left[: len(code)] >= n
                slot = (code * np.uint32(2654435769)) >> np.uint32(32 - BITS)
                out[row[: len(code)][inside], slot[inside] + (SPECTRUM.index(n) << BITS)] = 1
    return out


def normalised(present: np.ndarray) -> np.ndarray:
    """Rows scaled so that a product of two is the mean, over the lengths, of the normalised kernels."""
    parts = present.reshape(len(present), len(SPECTRUM), -1).astype(np.float32)
    norm = np.sqrt(np.maximum(parts.sum(axis=2, keepdims=True), 1) * len(SPECTRUM))
    return (parts / norm).reshape(len(present), -1)


def fit(bits: np.ndarray, languages: np.ndarray, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> tuple[list[str], np.ndarray]:
    """The languages and one column of weights for each, over n-grams; ``bits`` are packed presence rows.

    Landmarks are the first rows of each language. One-versus-rest kernel ridge regression on the
    Nystroem approximation gives a weight per landmark; as the kernel is a product of presence rows, the
    landmarks' rows and weights multiply out to one matrix, so scoring is a single matrix product.
    Rows are unpacked a few at a time; only the landmarks' rows are held.
    """
    names = sorted(set(languages.tolist()))
    landmarks = max(1, min(landmarks, MAX_LANDMARKS // len(names)))
    chosen = np.concatenate([np.flatnonzero(languages == name)[:landmarks] for name in names])

    def rows(at: np.ndarray) -> Iterator[np.ndarray]:
        for i in range(0, len(at), 64):
            yield normalised(np.unpackbits(bits[at[i : i + 64]], axis=1))

    held = np.empty((len(chosen), _WIDTH), dtype=np.float32)
    for i, part in enumerate(rows(chosen)):
        held[64 * i : 64 * i + len(part)] = part
    across = np.concatenate([part @ held.T for part in rows(np.arange(len(bits)))]).astype(np.float64)
    among = across[chosen]
    wanted = np.where(languages[:, None] == np.array(names)[None, :], 1.0, -1.0)
    # Languages count alike, however many rows each has.
    share = np.array([len(bits) / (len(names) * (languages == name).sum()) for name in languages])
    left = across.T @ (across * share[:, None]) + ridge * len(bits) * (among + 1e-6 * np.eye(len(among)))
    weights = np.linalg.solve(left, across.T @ (wanted * share[:, None]))
    return names, held.T @ weights.astype(np.float32)


def training_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed presence rows and languages of at most ``sample`` labelled rows per language, by hash of the id.

    Rows that share id and language are one row of the sample, the one with the smallest hash of its text. Rows
    whose hash is too large to be among the first are left out before rows of a language meet: a bound
    from counts lets some four times as many through as are wanted.
    """
    narrow = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(F.col(id_col)))
    narrow = narrow.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.xxhash64(id_col).alias("_h"), F.col(text_col).alias("_text"))
    counts = narrow.filter("_id is not null").groupBy("_lang").agg(F.count("*").alias("_n"))
    counts = saved(counts.orderBy(F.desc("_n"), "_lang").limit(MAX_LANGUAGES))
    languages = counts.count()
    if not languages:
        return np.zeros((0, _WIDTH // 8), np.uint8), np.zeros(0, dtype=object)
    sample = max(1, min(sample, MAX_SAMPLE // languages))

    def chosen_below(share: Column) -> DataFrame:
        """The first ids of each language by hash, among those whose hash is in the lowest ``share``."""
        limit = F.when(share >= 1, F.lit((1 << 63) - 1)).otherwise((F.lit(-float(1 << 63)) + share * float(1 << 64)).cast("long"))
        limits = F.broadcast(counts.select("_lang", limit.alias("_limit")))  # MAX_LANGUAGES rows at most
        ids = narrow.drop("_text").join(limits, "_lang").filter(F.col("_h") <= F.col("_limit")).select("_id", "_lang", "_h").distinct()
        rank = F.row_number().over(Window.partitionBy("_lang").orderBy("_h", "_id"))
        return saved(ids.withColumn("_rank", rank).filter(F.col("_rank") <= sample))

    chosen = chosen_below(F.lit(4.0 * sample) / F.col("_n"))
    found = counts.join(chosen.groupBy("_lang").agg(F.count("*").alias("_got")), "_lang", "left")
    if not found.filter((F.coalesce("_got", F.lit(0)) < sample) & (F.col("_n") > 4 * sample)).isEmpty():
        chosen = chosen_below(F.lit(1.0))  # ids that repeat very often
    rows = narrow.join(F.broadcast(chosen.select("_id", "_lang", "_rank")), ["_id", "_lang"])  # MAX_SAMPLE rows at most
    rows = rows.groupBy("_lang", "_rank").agg(F.min_by("_text", F.struct(F.xxhash64("_text"), "_text")).alias("_text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", 1 << 18):
            bits = np.packbits(presence(*raw_bytes(batch.column("_text"))), axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_lang"), batch.column("_rank"), pa.array([b.tobytes() for b in bits], pa.binary())],
                names=["_lang", "_rank", "bits"],
            )

    found = rows.select("_lang", "_rank", "_text").mapInArrow(work, "_lang string, _rank int, bits binary")
    found = found.orderBy("_lang", "_rank").collect()  # MAX_SAMPLE rows at most
    bits = np.frombuffer(b"".join(r["bits"] for r in found), np.uint8).reshape(len(found), _WIDTH // 8)
    return bits, np.array([r["_lang"] for r in found], dtype=object)


def identify(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, landmarks: int = LANDMARKS
) -> DataFrame:
    """One row per document: id, held_out, lang_pred, score (0 to 1).

    Fitted on a bounded sample of labelled rows (``sample`` per language), never on rows that crc32 of the
    id as text modulo 4 = 2 holds out. Whole texts are scored; the prediction sees the text only.
    ``und`` with score 0 if the text is null or has no letter, or if nothing was learned. Null ids and
    repeated rows are scored like others; null ids are not learned from, and rows that share id and
    language count once in the sample. Of more than MAX_LANGUAGES labels the most frequent are learned. Empty input gives no rows. Other columns are not read.
    """
    bits, languages = training_sample(docs, id_col, text_col, lang_col, sample)
    names, weights = fit(bits, languages, landmarks) if len(languages) else ([], np.zeros((_WIDTH, 0), np.float32))
    shared = docs.sparkSession.sparkContext.broadcast((names, weights))  # 200 KB per language

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, weights = shared.value
        for whole in slices(batches, "_text", 1 << 19):
            for i in range(0, whole.num_rows, 128):
                batch = whole.slice(i, 128)
                texts = batch.column("_text")
                lettered = np.asarray(pc.fill_null(pc.match_substring_regex(texts, _LETTER), False).cast(pa.int8())).astype(bool)
                if names:
                    scores = normalised(presence(*raw_bytes(texts))) @ weights
                    best = scores.argmax(axis=1)
                    odds = np.exp(4 * (scores - scores.max(axis=1, keepdims=True)))
                    score = odds[np.arange(len(best)), best] / odds.sum(axis=1)
                    found = np.where(lettered, np.array(names, dtype=object)[best], "und")
                    score = np.where(lettered, score, 0.0)
                else:
                    found, score = np.full(len(texts), "und", dtype=object), np.zeros(len(texts))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id"), pa.array(found.tolist(), pa.string()), pa.array(score.astype(np.float64))],
                    names=["_id", "lang_pred", "score"],
                )

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    out = rows.mapInArrow(work, f"_id {rows.schema['_id'].dataType.simpleString()}, lang_pred string, score double")
    return out.select(F.col("_id").alias(id_col), held_out(F.col("_id")).alias("held_out"), "lang_pred", "score")
