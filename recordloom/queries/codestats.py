"""Code statistics over `documents` (files), `lineitem` (commits), `events` (logs), `orders` and `pages`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions import fixed_values as V
from recordloom.functions.text import repo_name, repo_owner, repo_short_name
from recordloom.operators import codestats as C
from recordloom.queries.tables import table


def _files(spark: SparkSession, folder: str, repo) -> DataFrame:
    return table(spark, folder, "documents").select(
        repo.alias("repo"),
        F.concat(F.col("lang"), F.lit("/"), F.col("doc_id")).alias("path"),
        F.lit(False).alias("is_link"),
        F.col("text").cast("binary").alias("content"),
    )


def _file_lines(spark: SparkSession, folder: str) -> DataFrame:
    return C.source_files(_files(spark, folder, F.col("source")))


def file_totals(spark: SparkSession, folder: str) -> DataFrame:
    return C.file_totals(_file_lines(spark, folder))


def file_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return C.describe_distribution(_file_lines(spark, folder), "lines")


def _commit_log(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as log lines of their supplier's repository; returned items have no statistics."""
    deletions = F.round(F.col("l_discount") * 100).cast("int")
    stat = F.concat(
        F.lit(" 1 file changed, "),
        F.col("l_quantity").cast("int"),
        F.lit(" insertions(+)"),
        F.when(deletions > 0, F.concat(F.lit(", "), deletions, F.lit(" deletions(-)"))).otherwise(""),
    )
    sha = F.concat(F.lit("c0ffee"), F.col("l_orderkey"))
    return table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("repo"), F.when(F.col("l_returnflag") == "R", sha).otherwise(stat).alias("line")
    )


def shortstat_lines(spark: SparkSession, folder: str) -> DataFrame:
    lines = C.commit_lines_from_log(_commit_log(spark, folder))
    return lines.groupBy("repo", "lines").agg(F.count("*").alias("n"))


def commit_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return C.describe_distribution(C.commit_lines_from_log(_commit_log(spark, folder)), "lines")


def commit_json(spark: SparkSession, folder: str) -> DataFrame:
    """One stored answer per order: two commits and an empty node, or errors for status P."""
    node = F.concat(F.lit('{"additions":'), F.col("o_orderkey") % 50, F.lit(',"deletions":'), F.col("o_custkey") % 7, F.lit("}"))
    nodes = F.concat(F.lit('{"c0":'), node, F.lit(',"c1":null,"c2":{"additions":'), F.col("o_custkey") % 3, F.lit("}}"))
    errors = F.when(F.col("o_orderstatus") == "P", F.lit('"errors":[{"message":"x"}],')).otherwise("")
    body = F.concat(F.lit("{"), errors, F.lit('"data":{"repository":'), nodes, F.lit("}}"))
    answers = table(spark, folder, "orders").select(F.col("o_orderpriority").alias("repo"), body.alias("body"))
    lines = C.commit_lines_from_answers(answers)
    return lines.groupBy("repo", "lines").agg(F.count("*").alias("n"))


def _commits(spark: SparkSession, folder: str) -> DataFrame:
    """Events as commits of their user's repository, newest first, in two UTC offsets."""
    offset = F.when(F.col("event_type") == "click", "+02:00").otherwise("-08:00")
    return table(spark, folder, "events").select(
        F.col("user_id").alias("repo"),
        (-F.col("event_id")).alias("ord"),
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), offset).alias("authored_at"),
    )


def lifespan(spark: SparkSession, folder: str) -> DataFrame:
    return C.lifespan(_commits(spark, folder))


def commit_count(spark: SparkSession, folder: str) -> DataFrame:
    return C.commit_count(_commits(spark, folder))


def _user_lines(spark: SparkSession, folder: str) -> DataFrame:
    return C.source_files(_files(spark, folder, F.col("doc_id") % 150))


def loc_per_day(spark: SparkSession, folder: str) -> DataFrame:
    totals = C.file_totals(_user_lines(spark, folder))
    return C.loc_per_day(totals, C.lifespan(_commits(spark, folder))).select("repo", "total_lines", "lifespan_days", "loc_per_day")


def repo_report(spark: SparkSession, folder: str) -> DataFrame:
    user = F.col("user_id")
    url = F.concat(F.lit("https://github.com/o"), user % 7, F.lit("/repo-"), user, F.lit(".git"))
    repos = (
        table(spark, folder, "events")
        .select(user.alias("repo"), url.alias("url"), (user * 100).alias("size_kb"))
        .distinct()
    )
    changed = C.commit_lines_from_log(_commit_log(spark, folder))
    return C.repo_report(repos, _user_lines(spark, folder), _commits(spark, folder), changed)


def repo_urls(spark: SparkSession, folder: str) -> DataFrame:
    moved = F.regexp_replace("url", "^https?://[^/]+", "https://github.com")
    url = F.when(F.col("page_id") % 3 == 0, F.col("url")).otherwise(moved)
    return table(spark, folder, "pages").select(
        "page_id", repo_owner(url).alias("owner"), repo_short_name(url).alias("repo"), repo_name(url).alias("name")
    )


QUERIES = {
    "source_files": _file_lines,
    "file_totals": file_totals,
    "describe_distribution": file_distribution,
    "shortstat_lines": shortstat_lines,
    "commit_distribution": commit_distribution,
    "scan_commit_json": commit_json,
    "lifespan": lifespan,
    "commit_count": commit_count,
    "loc_per_day": loc_per_day,
    "repo_report": repo_report,
    "parse_repo_url": repo_urls,
}


def _sql_lines(repo: str) -> str:
    return f"""file_lines as (
  select repo, path, (length(t) - length(replace(t, chr(10), '')) + (t <> '' and right(t, 1) <> chr(10))::int)::bigint as lines
  from (select {repo} as repo, lang || '/' || doc_id as path,
    replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) as t from documents))"""


_SQL_DESCRIBED = """count(*) as n, sum(lines)::bigint as total, min(lines) as min, median(lines)::double as median,
  sum(lines)::double / count(*) as mean, max(lines) as max"""

_SQL_CHANGED = """commit_lines as (
  select l_suppkey as repo, (l_quantity::int + round(l_discount * 100)::int)::bigint as lines from lineitem where l_returnflag <> 'R')"""

_SQL_SPANS = """stamped as (
  select user_id as repo, event_id, strftime(ts, '%Y-%m-%d') as day,
    epoch(date_trunc('second', ts))::bigint - (case when event_type = 'click' then 2 else -8 end) * 3600 as moment
  from events),
spans as (
  select repo, count(*) as total_commits, arg_min(day, event_id) as first_date, arg_max(day, event_id) as last_date,
    floor((arg_max(moment, event_id) - arg_min(moment, event_id)) / 86400)::bigint as lifespan_days
  from stamped group by repo)"""

SQL = {
    "source_files": f"with {_sql_lines('source')} select repo, path, lines from file_lines",
    "file_totals": f"with {_sql_lines('source')} select repo, sum(lines)::bigint as total_lines, count(*) as total_files from file_lines group by repo",
    "describe_distribution": f"with {_sql_lines('source')} select repo, {_SQL_DESCRIBED} from file_lines group by repo",
    "shortstat_lines": f"with {_SQL_CHANGED} select repo, lines, count(*) as n from commit_lines group by repo, lines",
    "commit_distribution": f"with {_SQL_CHANGED} select repo, {_SQL_DESCRIBED} from commit_lines group by repo",
    "scan_commit_json": """with nodes as (
  select o_orderpriority as repo, unnest([o_orderkey % 50 + o_custkey % 7, o_custkey % 3]) as lines from orders where o_orderstatus <> 'P')
select repo, lines, count(*) as n from nodes where lines > 0 group by repo, lines""",
    "lifespan": f"with {_SQL_SPANS} select repo, total_commits, first_date, last_date, lifespan_days from spans",
    "commit_count": "select user_id as repo, count(*) as total_commits from events group by user_id",
    "loc_per_day": f"""with {_sql_lines('doc_id % 150')}, {_SQL_SPANS},
totals as (select repo, sum(lines)::bigint as total_lines from file_lines group by repo)
select repo, total_lines, lifespan_days, total_lines / greatest(lifespan_days, 1) as loc_per_day from totals join spans using (repo)""",
    "repo_report": f"""with {_sql_lines('doc_id % 150')}, {_SQL_SPANS}, {_SQL_CHANGED},
f as (select repo, {_SQL_DESCRIBED} from file_lines group by repo),
c as (select repo, {_SQL_DESCRIBED} from commit_lines group by repo)
select s.repo, 'o' || s.repo % 7 as owner, 'repo-' || s.repo as name, s.repo * 100 / 1024 as size_mb,
  coalesce(f.total, 0) as total_lines, coalesce(f.n, 0) as total_files, total_commits, first_date, last_date, lifespan_days,
  coalesce(f.total, 0) / greatest(lifespan_days, 1) as loc_per_day,
  f.min as file_min, f.median as file_median, f.mean as file_mean, f.max as file_max,
  coalesce(c.n, 0) as commits_with_lines,
  c.min as commit_min, c.median as commit_median, c.mean as commit_mean, c.max as commit_max
from spans s left join f on f.repo = s.repo left join c on c.repo = s.repo""",
    "parse_repo_url": rf"""with u as (
  select page_id, case when page_id % 3 = 0 then url else regexp_replace(url, '^https?://[^/]+', 'https://github.com') end as url from pages)
select page_id,
  nullif(regexp_extract(url, '{V.REPO_URL}', 1), '') as owner,
  nullif(regexp_extract(url, '{V.REPO_URL}', 2), '') as repo,
  regexp_replace(list_last(string_split(regexp_replace(url, '/+$', ''), '/')), '\.git$', '') as name
from u""",
}
