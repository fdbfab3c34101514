"""Quality rules whose cutoffs are set on labelled holdouts with exact binomial bounds."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.text_arrays import by_row, pack, raw_bytes, slices
from recordloom.operators.shared import saved

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Share of good documents of a stratum that all rules together may reject, and the chance that any
#: stratum loses more than that.
RISK, DELTA = 0.05, 0.05
#: Cutoffs per rule: a value is binned to whole parts of this.
GRID = 256
_SYMBOLS = b"#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks"]


@dataclass(frozen=True)
class Rule:
    """A share between 0 and 1; documents at or above the cutoff are rejected."""

    name: str
    value: Column


def rules() -> list[Rule]:
    def share(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.least(F.lit(1.0), F.col(part) / F.col(whole))).otherwise(0.0)

    return [
        Rule("symbols", share("n_symbols", "word_chars")),
        Rule("upper_case", share("n_upper", "word_chars")),
        Rule("marks", share("n_marks", "word_chars")),
        Rule("repeated_lines", share("n_dup_lines", "n_lines")),
        Rule("repeated_words", share("n_repeat_words", "n_words")),
    ]


def _repeat_words(words, k: int) -> np.ndarray:
    """Words of each row in k-word windows that occur twice or more in the row."""
    begin = words.windows(k)
    end = words.ends[begin + k - 1]
    row = words.row
    with np.errstate(over="ignore"):
        key = words.hash(words.starts[begin], end) ^ (row[begin].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    a, b = order[:-1], order[1:]
    met = key[a] == key[b]
    a, b = begin[a[met]], begin[b[met]]
    length = words.ends[a + k - 1] - words.starts[a]
    alike = (length == words.ends[b + k - 1] - words.starts[b]) & (row[a] == row[b])
    alike[alike] = words.same(words.starts[a[alike]], words.starts[b[alike]], length[alike])
    covered = np.zeros(len(words.starts) + 1, dtype=np.int64)
    if alike.all():
        hit = np.unique(np.concatenate([a, b]))
    else:  # two windows share a hash and differ: these rows are counted by their texts
        hit = np.unique(np.concatenate([a[alike], b[alike]]))
        text = words.text()
        for r in np.unique(np.concatenate([row[a[~alike]], row[b[~alike]]])).tolist():
            at: dict[bytes, list[int]] = {}
            for i in range(words.first[r], words.first[r + 1] - k + 1):
                at.setdefault(text[words.starts[i] : words.ends[i + k - 1]], []).append(i)
            hit = np.union1d(hit, [i for found in at.values() if len(found) > 1 for i in found]).astype(np.int64)
    covered[hit] += 1
    covered[hit + k] -= 1
    return by_row(words, np.cumsum(covered[:-1]) > 0)


def _class(chars: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(chars)] = True
    return table


def _counts(texts: pa.Array) -> dict[str, np.ndarray]:
    data, offsets = raw_bytes(texts)
    words = pack(data, offsets)
    upto = words.ends[words.first[1:] - 1] if len(words.ends) else np.zeros(len(offsets) - 1, np.int64)
    ends = np.where(words.first[1:] > 0, upto, 0)

    def over_rows(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags)])[ends]
        return np.diff(np.concatenate([[0], sums]))

    blank = words.data == 0x20
    whole = data.tobytes()
    lines, copies = [], []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        own = [line for line in whole[a:b].split(b"\n") if line.strip()]
        lines.append(len(own))
        copies.append(len(own) - len(set(own)))
    return {
        "n_words": words.n_words,
        "word_chars": over_rows(((words.data & 0xC0) != 0x80) & ~blank),
        "n_symbols": over_rows(_class(_SYMBOLS)[words.data]),
        "n_dup_lines": np.array(copies, dtype=np.int64),
        "n_repeat_words": _repeat_words(words, WINDOW),
        "n_lines": np.array(lines, dtype=np.int64),
        "n_upper": over_rows((words.data >= 0x41) & (words.data <= 0x5A)),
        "n_marks": over_rows(_class(b"!?")[words.data]),
    }


def features(docs: DataFrame, text_col: str, carry: list[str]) -> DataFrame:
    """The counts of each text beside the columns ``carry``, which are named _c0, _c1, ... in their order.

    Null text is empty: all counts 0.
    """
    names = [f"_c{i}" for i in range(len(carry))]
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(carry, names, strict=True)], F.col(f"`{text_col}`").alias("_text"))
    text = names[carry.index(text_col)] if text_col in carry else "_text"
    rows = rows.drop("_text") if text_col in carry else rows

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            found = _counts(batch.column(text))
            columns = [batch.column(n) for n in names] + [pa.array(found[c].astype(np.int64)) for c in COUNTS]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *COUNTS])

    fields = [f"{n} {docs.schema[c].dataType.simpleString()}" for c, n in zip(carry, names, strict=True)]
    return rows.mapInArrow(work, ", ".join(fields + [f"{c} long" for c in COUNTS]))


def base_failed() -> Column:
    many = 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    return (F.col("n_words") < MIN_WORDS) | many


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X of n trials with chance p, exactly summed."""
    if k >= n:
        return 1.0
    i = np.arange(k + 1)
    logs = np.concatenate([[0.0], np.cumsum(np.log(n - i[:-1]) - np.log(i[1:]))]) if k else np.zeros(1)
    return float(min(1.0, np.exp(logs + i * math.log(p) + (n - i) * math.log1p(-p)).sum()))


def certified_cutoff(good: np.ndarray, bad: np.ndarray, risk: float, delta: float) -> int | None:
    """The bin from which on documents may be rejected; None if no cutoff is certified.

    ``good`` and ``bad`` count labelled documents per bin. Cutoffs are tested in a fixed order, from the
    top bin down, each against "more than ``risk`` of the good documents are rejected" by the exact
    binomial tail, which is the test that belongs to the exact (Clopper-Pearson) upper bound; the first
    failure ends the sequence, so no correction among cutoffs is needed. Of the certified cutoffs that
    reject more bad than good documents, the highest that rejects 99 % of the bad ones they can is taken.
    """
    n, certified = int(good.sum()), []
    lost = np.cumsum(good[::-1])[::-1]
    for b in range(len(good) - 1, 0, -1):
        if not n or binomial_tail(int(lost[b]), n, risk) > delta:
            break
        certified.append(b)
    caught = np.cumsum(bad[::-1])[::-1]
    useful = [b for b in certified if caught[b] > lost[b]]
    if not useful:
        return None
    return max(b for b in useful if caught[b] >= 0.99 * caught[useful[-1]])


def thresholds(
    found: DataFrame, labels: DataFrame, stratum_col: str, id_col: str, risk: float = RISK, delta: float = DELTA
) -> DataFrame:
    """(stratum, rule, cutoff): the certified cutoffs, from all labelled documents that the base rules keep.

    The risk is shared among the rules and delta among rules and strata (Bonferroni), so with chance
    1 - delta no stratum loses more than ``risk`` of its good documents to all rules together. A stratum
    with too few good documents gets no cutoff and loses none. Only counts per (stratum, rule, bin) are
    gathered. Labels of null quality are left out; several labels of one document count once each.
    """
    spark, own = found.sparkSession, rules()
    labels = labels.filter("quality is not null").select(F.col("doc_id").alias("_label_of"), "quality")
    held = found.filter(~F.col("base_failed")).join(labels, F.col(id_col) == F.col("_label_of"))
    bins = F.array(*[F.struct(F.lit(i).alias("rule"), F.floor(r.value * (GRID - 1)).cast("int").alias("bin")) for i, r in enumerate(own)])
    counted = held.select(F.col(stratum_col).alias("stratum"), (F.col("quality") > 0).alias("good"), F.explode(bins).alias("x"))
    counted = saved(counted.groupBy("stratum", "good", "x.rule", "x.bin").count())
    strata = max(1, counted.select("stratum").distinct().count())
    risk, delta = risk / len(own), delta / (len(own) * strata)
    kind = found.schema[stratum_col].dataType.simpleString()

    def certify(key: tuple, table: pa.Table) -> pa.Table:
        histogram = np.zeros((2, GRID), dtype=np.int64)
        good = np.asarray(table.column("good").cast(pa.int8()))
        np.add.at(histogram, (good, np.asarray(table.column("bin"))), np.asarray(table.column("count")))
        cutoff = certified_cutoff(histogram[1], histogram[0], risk, delta)
        rows = [] if cutoff is None else [cutoff / (GRID - 1)]
        return pa.table(
            {"stratum": table.column("stratum").slice(0, len(rows)), "rule": pa.array([key[1].as_py()] * len(rows), pa.int32()), "cutoff": pa.array(rows, pa.float64())}
        )

    out = counted.groupBy("stratum", "rule").applyInArrow(certify, f"stratum {kind}, rule int, cutoff double")
    names = spark.createDataFrame([(i, r.name) for i, r in enumerate(own)], "rule int, name string")
    out = out.join(F.broadcast(names), "rule")  # as many rows as there are rules
    return out.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("name", "cutoff"))).alias("cutoffs"))


def judged(found: DataFrame, cutoffs: DataFrame, stratum_col: str) -> DataFrame:
    """Adds ``failed_rules`` (names) and ``kept``: passes the base rules and every cutoff of its stratum."""
    of = cutoffs.select(F.col("stratum").alias("_stratum"), "cutoffs")
    found = found.join(of, F.col(stratum_col).eqNullSafe(F.col("_stratum")), "left")
    # Values are binned as in the calibration, so a value at a cutoff is on the same side of it in both.
    binned = [(r.name, F.floor(r.value * (GRID - 1)) / (GRID - 1)) for r in rules()]
    failed = [F.when(v >= F.element_at("cutoffs", F.lit(name)), F.lit(name)) for name, v in binned]
    found = found.withColumn("failed_rules", F.array_compact(F.array(*failed)))
    kept = ~F.col("base_failed") & (F.size("failed_rules") == 0)
    return found.withColumn("kept", kept).drop("_stratum", "cutoffs")


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """One row per document: id, counts, base_failed, failed_rules, kept.

    Null or empty text has no words and fails the base rules. A null stratum is a stratum. Null ids have
    no labels; repeated rows are judged alike. Empty input gives no rows; without labels only the base
    rules decide. Other columns are not read.
    """
    found = saved(features(docs, text_col, [id_col, stratum_col]).withColumn("base_failed", base_failed()))
    out = judged(found, thresholds(found, labels, "_c1", "_c0"), "_c1").withColumnRenamed("_c0", id_col)
    return out.drop("_c1")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """The documents that all rules keep, with all their columns.

    The texts are counted a second time for the verdict rather than shuffled to it.
    """
    found = saved(features(docs, text_col, [id_col, stratum_col]).withColumn("base_failed", base_failed()))
    cutoffs = saved(thresholds(found, labels, "_c1", "_c0"))
    names = docs.columns
    rows = features(docs, text_col, names).withColumn("base_failed", base_failed())
    rows = judged(rows, cutoffs, f"_c{names.index(stratum_col)}").filter("kept")
    return rows.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(names)])
