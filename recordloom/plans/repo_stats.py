"""Repository statistics from stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recordloom.operators.codestats import (
    commit_lines_from_answers,
    commit_lines_from_log,
    repo_report,
    source_files,
)
from recordloom.sources.tables import read_appended, write_snapshot


def report(spark: SparkSession, folder: str) -> DataFrame:
    """One row per repository from ``folder/{repos,files,commits,commit_log,api_answers}``.

    Changed lines come from the stored logs, and from the stored answers for repositories that have
    no log. A folder may lack either.
    """

    def stored(name: str) -> DataFrame | None:
        return read_appended(spark, f"{folder}/{name}")

    log, answers = stored("commit_log"), stored("api_answers")
    parts = []
    if log is not None:
        parts.append(commit_lines_from_log(log))
    if answers is not None:
        if log is not None:
            answers = answers.join(log.select("repo").distinct(), "repo", "left_anti")
        parts.append(commit_lines_from_answers(answers))
    if not parts:
        parts.append(spark.createDataFrame([], "repo string, lines long"))
    changed = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return repo_report(stored("repos"), source_files(stored("files")), stored("commits"), changed)


def write_report(spark: SparkSession, folder: str, out: str) -> str:
    """Writes the report as the next version below ``out``; returns its path."""
    return write_snapshot(report(spark, folder), out)
