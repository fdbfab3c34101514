"""Stored output of the version control tool and stored API answers, one file per repository.

The repository is the file name without its ending, so names may hold dots; files in folders ``repo=<name>``,
as Spark writes them, belong to the repository of the folder. Files in folders ``bundle=<name>`` hold many
repositories: each line begins with the name of its repository, URL-encoded, and a tab.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions.text import strip


def _repo() -> Column:
    file = F.regexp_extract(F.col("_metadata.file_name"), r"^(.+?)(\.[^.]*)?$", 1)
    folder = F.url_decode(F.regexp_extract(F.col("_metadata.file_path"), r"/repo=([^/]+)/[^/]+$", 1))
    return F.when(folder != "", folder).otherwise(file)


def write_lines(lines: DataFrame, path: str) -> None:
    """Stores lines ``(repo, ord, value)`` below ``path`` in bundles, so files are as many as the size asks for.

    The lines of a repository stand together, by ``ord``. A null repository has the name Spark gives to its folder.
    """
    name = F.coalesce(F.col("repo").cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))
    begin = F.concat(F.url_encode(name), F.lit("\t"))
    value = F.coalesce("value", F.lit(""))
    text = F.concat(begin, F.replace(value, F.lit("\n"), F.concat(F.lit("\n"), begin)))
    lines = lines.select("repo", "ord", text.alias("value")).repartition("repo").sortWithinPartitions("repo", "ord")
    lines.select("value").write.text(f"{path}/bundle=0")


def _lines(spark: SparkSession, path: str | Sequence[str], name: str) -> DataFrame:
    """``(repo, ord, <name>)`` of the lines that are not blank; ``ord`` rises through each file.

    A piece of a file that is not its last one fills its partition alone, and a line takes at least one
    byte, so the start of the piece plus the row number rises.
    """
    bundled = F.col("_metadata.file_path").rlike(r"/bundle=[^/]+/[^/]+$")
    repo = F.when(bundled, F.try_url_decode(F.substring_index("value", "\t", 1))).otherwise(_repo())
    text = F.when(bundled, F.regexp_extract("value", r"(?s)^[^\t]*\t(.*)$", 1)).otherwise(F.col("value"))
    row = F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))
    lines = spark.read.text(path if isinstance(path, str) else list(path)).select(
        repo.alias("repo"),
        (F.col("_metadata.file_block_start") + row).alias("ord"),
        strip(text).alias(name),
    )
    return lines.filter(F.col(name) != "")


def scan_commit_log(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Stored logs with shortstat lines: ``(repo, ord, line)``."""
    return _lines(spark, path, "line")


def scan_commit_dates(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Stored author dates, newest first: ``(repo, ord, authored_at)``."""
    return _lines(spark, path, "authored_at")


def scan_answers(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Stored API answers, one JSON document per line: ``(repo, body)``."""
    return _lines(spark, path, "body").drop("ord")
