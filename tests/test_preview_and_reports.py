import datetime

from recordloom.plans.preview import preview
from recordloom.plans.repo_stats import write_report
from recordloom.sources.preview import parquet_head, parquet_row_count, parquet_schema

ORDERS = "/root/testdata/sf0.001/orders.parquet"


def test_preview(spark, tmp_path):
    schema, rows, note = preview(spark, ORDERS)
    assert [(r.pos, r.name, r.type) for r in schema.orderBy("pos").collect()][:2] == [(0, "o_orderkey", "bigint"), (1, "o_custkey", "bigint")]
    assert rows.count() == 3 and note is None
    assert parquet_head(spark, ORDERS, 0).count() == 0
    total = parquet_row_count(spark, ORDERS).first().n
    assert parquet_head(spark, ORDERS, 10**6).count() == total
    spark.range(0).write.parquet(str(tmp_path / "none"))
    assert preview(spark, str(tmp_path / "none"))[2] == "the table has 0 rows"
    assert preview(spark, str(tmp_path / "none"), 0)[2] is None


def test_schema_of_nested_types(spark, tmp_path):
    spark.sql("select array(1) a, named_struct('x', 1.5D) b").write.parquet(str(tmp_path / "t"))
    assert {r.name: r.type for r in parquet_schema(spark, str(tmp_path / "t")).collect()} == {"a": "array<int>", "b": "struct<x:double>"}


def test_repository_report_from_stored_tables(spark, tmp_path):
    day = datetime.date(2024, 1, 1).isoformat()

    def store(name, rows, kind):
        spark.createDataFrame(rows, kind).write.parquet(str(tmp_path / "in" / name))

    store("repos", [("a", "https://github.com/o/a", 1024), ("b", "https://github.com/o/b", 512)], "repo string, url string, size_kb long")
    store("files", [("a", "x", False, b"1\n2\n"), ("b", "y", False, b"1")], "repo string, path string, is_link boolean, content binary")
    store("commits", [("a", 0, "s", f"{day}T00:00:00+00:00"), ("b", 0, "s", f"{day}T00:00:00+00:00")], "repo string, ord long, sha string, authored_at string")
    store("commit_log", [("a", 0, " 1 file changed, 4 insertions(+)")], "repo string, ord long, line string")
    answer = '{"data":{"repository":{"c0":{"additions":9,"deletions":0}}}}'
    store("api_answers", [("a", answer), ("b", answer)], "repo string, body string")
    target = write_report(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    found = {r.repo: (r.total_lines, r.commit_max, r.size_mb) for r in spark.read.parquet(target).collect()}
    assert found == {"a": (2, 4, 1.0), "b": (1, 9, 0.5)}


def test_stored_logs_dates_and_answers(spark, tmp_path):
    from recordloom.operators.codestats import commit_lines_from_answers, commit_lines_from_log, lifespan
    from recordloom.sources.repo_files import scan_answers, scan_commit_dates, scan_commit_log

    for folder in ("log", "dates", "answers"):
        (tmp_path / folder).mkdir()
    for repo, changed in (("a", 3), ("b", 5)):
        (tmp_path / "log" / f"{repo}.txt").write_text(f"c0ffee\n 1 file changed, {changed} insertions(+)\n\nbeef\n")
        days = [f"2024-01-{31 - i:02d}T00:00:00+00:00" for i in range(changed)]
        (tmp_path / "dates" / f"{repo}.txt").write_text("\n".join(days) + "\n")
        (tmp_path / "answers" / f"{repo}.json").write_text('{"data":{"repository":{"c0":{"additions":%d,"deletions":1}}}}' % changed)
    log = scan_commit_log(spark, str(tmp_path / "log"))
    assert {r.repo: r.lines for r in commit_lines_from_log(log).collect()} == {"a": 3, "b": 5}
    assert [r.line for r in log.filter("repo = 'a'").orderBy("ord").collect()][0] == "c0ffee"
    spans = lifespan(scan_commit_dates(spark, str(tmp_path / "dates")))
    assert {r.repo: (r.first_date, r.last_date, r.lifespan_days) for r in spans.collect()} == {
        "a": ("2024-01-29", "2024-01-31", 2),
        "b": ("2024-01-27", "2024-01-31", 4),
    }
    answers = scan_answers(spark, str(tmp_path / "answers"))
    assert {r.repo: r.lines for r in commit_lines_from_answers(answers).collect()} == {"a": 4, "b": 6}


def test_lines_of_many_repositories_share_files(spark, tmp_path):
    """Names of any characters, a null name, blank and null lines, and lines within a value; files do not grow with repositories."""
    from recordloom.sources.repo_files import scan_commit_log, write_lines

    names = ["a b", "x/y\t%", "é.git", None, *[f"r{i}" for i in range(300)]]
    rows = [(name, i, f" {name} {i}\n\tsecond\n") for name in names for i in (2, 1)] + [("a b", 3, None)]
    write_lines(spark.createDataFrame(rows, "repo string, ord long, value string"), str(tmp_path))
    assert len(list(tmp_path.glob("*/part-*"))) <= 8
    got = {}
    for r in scan_commit_log(spark, f"{tmp_path}/*/part-*").orderBy("repo", "ord").collect():
        got.setdefault(r.repo, []).append(r.line)
    assert got == {n or "__HIVE_DEFAULT_PARTITION__": [f"{n} 1", "second", f"{n} 2", "second"] for n in names}
