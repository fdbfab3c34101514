"""Size, change and lifespan statistics over many code repositories.

Inputs are stored tables: ``files(repo, path, is_link, content)``, ``commit_log(repo, ord, line)``,
``commits(repo, ord, sha, authored_at)`` newest first, ``api_answers(repo, body)`` and
``repos(repo, url, size_kb)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordloom.functions.numbers import days_between, size_mb
from recordloom.functions.text import has_shortstat, is_text, line_count, repo_name, repo_owner, shortstat_lines

BY = ("repo",)


def source_files(files: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """``(by, path, lines)`` of the text files; links and anything below a ``.git`` folder are left out."""
    below_git = F.array_contains(F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1), ".git")
    kept = files.filter(~F.col("is_link") & ~F.coalesce(below_git, F.lit(False))).filter(is_text(F.col("content")))
    return kept.select(*by, "path", line_count(F.col("content").cast("string")).alias("lines"))


def file_totals(lines: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Lines and files; an empty file counts as a file."""
    return lines.groupBy(*by).agg(F.sum("lines").alias("total_lines"), F.count("*").alias("total_files"))


def describe_distribution(values: DataFrame, value: str, by: Sequence[str] = BY) -> DataFrame:
    """``n, total, min, median, mean, max`` with the exact median; no values, no row.

    Equal values are counted first, inside the map tasks too, so a group is reduced to its distinct
    values before its rows come together; the median is where the running count passes the middle.
    """
    whole = values.schema[value].dataType.typeName() in ("byte", "short", "integer", "long")
    counted = (
        values.filter(F.col(value).isNotNull())
        .groupBy(*by, (F.col(value).cast("long") if whole else F.col(value)).alias("_v"))
        .agg(F.count("*").alias("_n"))
    )
    group = Window.partitionBy(*by)
    upto = F.sum("_n").over(group.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    v, n, size = F.col("_v"), F.col("_n"), F.col("_size")

    def at(position):
        holds = (F.col("_upto") >= position) & (F.col("_upto") - n < position)
        return F.max(F.when(holds, v))

    lower = F.call_function("div", size + 1, F.lit(2))
    upper = F.call_function("div", size + 2, F.lit(2))
    total = F.sum(v * n)
    described = (
        counted.withColumn("_upto", upto)
        .withColumn("_size", F.sum("_n").over(group))
        .groupBy(*by)
        .agg(
            F.sum("_n").alias("n"),
            total.alias("total"),
            F.min("_v").alias("min"),
            ((at(lower) + at(upper)) / 2).alias("median"),
            F.try_divide(total, F.sum("_n")).alias("mean"),
            F.max("_v").alias("max"),
        )
    )
    return described.filter("n > 0")


def commit_lines_from_log(commit_log: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """``(by, lines)`` per commit with a shortstat line; a sum of 0 stays."""
    stated = commit_log.filter(has_shortstat(F.col("line")))
    return stated.select(*by, shortstat_lines(F.col("line")).alias("lines"))


def commit_lines_from_answers(answers: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """``(by, lines)`` per commit of stored batch answers; a sum of 0 goes, as do answers with errors."""
    shape = (
        "errors string, "
        "data struct<repository: map<string, struct<additions: bigint, deletions: bigint>>>"
    )
    read = answers.select(*by, F.from_json("body", shape).alias("_a"))
    # Not a filter: it would be moved below the parsing and parse every answer twice.
    usable = F.when(F.col("_a.errors").isNull(), F.col("_a.data.repository"))
    nodes = read.select(*by, F.explode(usable).alias("_alias", "_node"))
    zero = F.lit(0).cast("long")
    lines = F.coalesce("_node.additions", zero) + F.coalesce("_node.deletions", zero)
    return nodes.filter("_node is not null").select(*by, lines.alias("lines")).filter("lines > 0")


def commit_count(commits: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    return commits.groupBy(*by).agg(F.count("*").alias("total_commits"))


def lifespan(commits: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """First and last commit are the ends of the log; the days between them may be negative."""
    ends = commits.groupBy(*by).agg(
        F.count("*").alias("total_commits"),
        F.max_by("authored_at", "ord").alias("_first"),
        F.min_by("authored_at", "ord").alias("_last"),
    )
    days = days_between(F.col("_first").try_cast("timestamp"), F.col("_last").try_cast("timestamp"))
    return ends.select(
        *by,
        "total_commits",
        # The date in the commit's own offset, as written.
        F.substring("_first", 1, 10).alias("first_date"),
        F.substring("_last", 1, 10).alias("last_date"),
        days.alias("lifespan_days"),
    )


def loc_per_day(totals: DataFrame, spans: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    per_day = F.col("total_lines") / F.greatest(F.col("lifespan_days"), F.lit(1))
    return totals.join(spans, list(by)).withColumn("loc_per_day", per_day)


def repo_report(
    repos: DataFrame, lines: DataFrame, commits: DataFrame, commit_lines: DataFrame, by: Sequence[str] = BY
) -> DataFrame:
    """One row per repository. Each input is reduced to one row per repository before it is joined."""

    def described(values: DataFrame, prefix: str) -> DataFrame:
        found = describe_distribution(values, "lines", by)
        return found.select(*by, *[F.col(c).alias(f"{prefix}_{c}") for c in ("n", "total", "min", "median", "mean", "max")])

    joined = (
        repos.join(lifespan(commits, by), list(by))
        .join(described(lines, "file"), list(by), "left")
        .join(described(commit_lines, "commit"), list(by), "left")
    )
    zero = F.lit(0).cast("long")
    total = F.coalesce("file_total", zero)
    return joined.select(
        *by,
        repo_owner(F.col("url")).alias("owner"),
        repo_name(F.col("url")).alias("name"),
        size_mb(F.col("size_kb")).alias("size_mb"),
        total.alias("total_lines"),
        F.coalesce("file_n", zero).alias("total_files"),
        "total_commits",
        "first_date",
        "last_date",
        "lifespan_days",
        (total / F.greatest(F.col("lifespan_days"), F.lit(1))).alias("loc_per_day"),
        *[f"file_{c}" for c in ("min", "median", "mean", "max")],
        F.coalesce("commit_n", zero).alias("commits_with_lines"),
        *[f"commit_{c}" for c in ("min", "median", "mean", "max")],
    )
