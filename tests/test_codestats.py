import random
import statistics

import pytest

from recordloom.operators import codestats as C


def test_source_files(spark):
    rows = [
        ("r", "a.py", False, b"x\ny\n"),
        ("r", "empty", False, b""),
        ("r", ".gitignore", False, b"z"),
        ("r", "sub/.git", False, b"gitdir: x\n"),  # a file of that name counts
        ("r", ".git/HEAD", False, b"ref\n"),
        ("r", "v/.git/x", False, b"ref\n"),
        ("r", "link", True, b"x\n"),
        ("r", "bin", False, b"\xff\xfe"),
        ("q", "b", False, b"1\r\n2\r3"),
    ]
    files = spark.createDataFrame(rows, "repo string, path string, is_link boolean, content binary")
    lines = C.source_files(files)
    assert {(r.repo, r.path): r.lines for r in lines.collect()} == {("r", "a.py"): 2, ("r", "empty"): 0, ("r", ".gitignore"): 1, ("r", "sub/.git"): 1, ("q", "b"): 3}
    assert {r.repo: (r.total_lines, r.total_files) for r in C.file_totals(lines).collect()} == {"r": (4, 4), "q": (3, 1)}


def test_distribution(spark):
    rnd = random.Random(4)
    groups = {"a": [1, 2, 3, 4], "b": [7], "c": [rnd.randint(0, 50) for _ in range(501)], "d": [rnd.randint(0, 9) for _ in range(500)]}
    rows = [(k, v) for k, values in groups.items() for v in values] + [("none", None)]
    found = {r.repo: r for r in C.describe_distribution(spark.createDataFrame(rows, "repo string, lines long"), "lines").collect()}
    assert set(found) == set(groups)
    for k, values in groups.items():
        r = found[k]
        assert (r.n, r.total, r.min, r.max) == (len(values), sum(values), min(values), max(values))
        assert r.median == statistics.median(values) and r.mean == pytest.approx(statistics.mean(values))
    empty = spark.createDataFrame([], "lines long")
    assert C.describe_distribution(empty, "lines", by=()).count() == 0


def test_commit_lines(spark):
    log = ["abc123", " 3 files changed, 10 insertions(+), 2 deletions(-)", "", "def", " 1 file changed, 0 insertions(+), 0 deletions(-)", "aaa"]
    frame = spark.createDataFrame([("r", i, l) for i, l in enumerate(log)], "repo string, ord long, line string")
    assert sorted(r.lines for r in C.commit_lines_from_log(frame).collect()) == [0, 12]
    answers = [
        '{"data":{"repository":{"c0":{"additions":3,"deletions":4},"c1":null,"c2":{"additions":0,"deletions":0},"c3":{"additions":5},"c4":{}}}}',
        '{"errors":[{"message":"x"}],"data":{"repository":{"c0":{"additions":1,"deletions":1}}}}',
        '{"data":{}}',
        "not json",
    ]
    frame = spark.createDataFrame([("r", a) for a in answers], "repo string, body string")
    assert sorted(r.lines for r in C.commit_lines_from_answers(frame).collect()) == [5, 7]


def test_lifespan_uses_the_ends_of_the_log(spark):
    rows = [
        ("r", 0, "s", "2024-03-01T10:00:00+02:00"),
        ("r", 1, "s", "2030-01-01T00:00:00+00:00"),
        ("r", 2, "s", "2024-01-01T23:30:00-08:00"),
        ("n", 0, "s", "2024-01-01T00:00:00+00:00"),
        ("n", 1, "s", "2024-01-02T00:00:00+00:00"),
    ]
    found = {r.repo: tuple(r)[1:] for r in C.lifespan(spark.createDataFrame(rows, "repo string, ord long, sha string, authored_at string")).collect()}
    assert found == {"r": (3, "2024-01-01", "2024-03-01", 59), "n": (2, "2024-01-02", "2024-01-01", -1)}


def test_report(spark):
    repos = spark.createDataFrame([("r", "https://github.com/o/r.git", 2048), ("n", "https://example.org/x/n", None)], "repo string, url string, size_kb long")
    lines = spark.createDataFrame([("r", "a", 10), ("r", "b", 20)], "repo string, path string, lines long")
    commits = spark.createDataFrame(
        [("r", 0, "s", "2024-01-11T00:00:00+00:00"), ("r", 1, "s", "2024-01-01T00:00:00+00:00"), ("n", 0, "s", "2024-01-01T00:00:00+00:00")],
        "repo string, ord long, sha string, authored_at string",
    )
    changed = spark.createDataFrame([("r", 5)], "repo string, lines long")
    found = {r.repo: r for r in C.repo_report(repos, lines, commits, changed).collect()}
    r, n = found["r"], found["n"]
    assert (r.owner, r.name, r.size_mb, r.total_lines, r.total_files, r.total_commits, r.loc_per_day) == ("o", "r", 2.0, 30, 2, 2, 3.0)
    assert (r.file_median, r.commit_max) == (15.0, 5)
    assert (n.owner, n.name, n.size_mb, n.total_lines, n.lifespan_days, n.loc_per_day, n.file_min) == (None, "n", None, 0, 0, 0.0, None)
