"""Exact duplicates: 128-bit content hash, smallest id per group, bytes compared inside the groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.operators.shared import saved

GAPS = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """The text with each run of blanks replaced by one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), GAPS, " ")


def content_hash(text: Column) -> Column:
    return F.md5(text)


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    hash_of: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    Documents are grouped by the 128-bit hash and the normalised text together, so Spark compares the
    bytes of all texts that meet under a hash. Copies shrink to one row per map task before the shuffle,
    however many there are. Rows get their group through the hash alone; only where one hash has several
    texts (none in practice; ``hash_of`` is a parameter so that tests can force it) the texts themselves
    are joined.

    Null text is empty text. A null id is never the smallest; in a group of null ids keep_id is null and
    its rows count as kept. Rows that repeat id and text are all marked as the kept one
    (``drop_exact_copies`` returns one). Other columns are not read, whatever their names.
    """
    texts = docs.select(F.col(id_col).alias("_id"), normalised(F.col(text_col)).alias("_text"))
    texts = texts.withColumn("_key", hash_of(F.col("_text")))
    whole = texts.groupBy("_key", "_text").agg(F.min("_id").alias("keep_id"), F.count("*").alias("group_size"))
    digest = F.sha2(F.encode("_text", "UTF-8"), 256)
    groups = saved(whole.select("_key", "keep_id", "group_size", digest.alias("text_sha256")))
    collided = groups.groupBy("_key").count().filter("count > 1").select("_key")
    ids = texts.select("_id", "_key")
    if collided.isEmpty():
        found = ids.join(groups, "_key")
    else:
        collided = saved(collided)
        mixed = texts.join(collided, "_key", "left_semi")
        several = whole.join(collided, "_key", "left_semi").withColumn("text_sha256", digest)
        found = ids.join(collided, "_key", "left_anti").join(groups, "_key")
        found = found.unionByName(mixed.join(several, ["_key", "_text"]).drop("_text"))
    kept = F.col("_id").eqNullSafe(F.col("keep_id"))
    return found.select(F.col("_id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns: one per group of equal texts.

    Of rows that repeat both id and text one stays (any one, should their other columns differ).
    """
    names = docs.columns
    docs = docs.toDF(*[f"_c{i}" for i in range(len(names))])  # no name of theirs can clash with ours
    own, text = f"_c{names.index(id_col)}", f"_c{names.index(text_col)}"
    found = saved(exact_groups(docs, own, text).select(F.col(own).alias("_gone"), "kept", F.col("text_sha256").alias("_sha_of")))
    kept, gone = found.filter("kept"), found.filter("not kept")
    single = kept.groupBy("_gone").count().filter("count > 1").isEmpty()
    if single and kept.select("_gone").join(gone.select("_gone"), "_gone", "left_semi").isEmpty():
        # An id stands for one row: those that go, the smaller part, are all that has to be known.
        return docs.join(saved(gone.select("_gone")), F.col(own).eqNullSafe(F.col("_gone")), "left_anti").toDF(*names)
    rows = docs.withColumn("_sha", F.sha2(F.encode(normalised(F.col(text)), "UTF-8"), 256))
    same = F.col(own).eqNullSafe(F.col("_gone")) & (F.col("_sha") == F.col("_sha_of"))
    rows = rows.join(kept, same, "left_semi").dropDuplicates([own, "_sha"])
    return rows.drop("_sha").toDF(*names)
