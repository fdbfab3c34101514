import random

import pytest
from pyspark.sql import functions as F

from recordloom.operators.intervals import interval_overlap, keep_records, merge_intervals, top_level


def fold(windows):
    """Windows in order, each extending the last one or opening a new one."""
    out = []
    for start, end in sorted(w for w in windows if w[0] and w[1]):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return sorted(tuple(w) for w in out)


def overlaps(windows, start, end):
    return start is not None and end is not None and any(s <= end and e >= start for s, e in windows)


def minute(n):
    return f"2024-01-{1 + n // 1440:02d} {n // 60 % 24:02d}:{n % 60:02d}:00"


def sample(seed, n, spread, backwards=0.1):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        a = rnd.randint(0, spread)
        b = a + rnd.choice([0, 3, 10, 50, 400])
        out.append((minute(b), minute(a)) if rnd.random() < backwards else (minute(a), minute(b)))
    return out


def merged(spark, rows, **options):
    df = spark.createDataFrame(rows, "start string, end string")
    found = merge_intervals(df, **options).collect()
    return sorted((r.start, r.end) for r in found for _ in range(r.copies))


@pytest.mark.parametrize("large", [1 << 20, 5])
@pytest.mark.parametrize("seed,n,spread,chars", [(1, 200, 20_000, 13), (2, 300, 3_000, 13), (3, 100, 9_000, 10), (4, 150, 2_000, 16)])
def test_merge_equals_the_fold(spark, seed, n, spread, chars, large):
    rows = sample(seed, n, spread)
    rows += rows[:20] + [(minute(100), ""), ("", minute(3)), (None, None)]
    rows += [(minute(25_000), minute(7))] * 3 + [(minute(25_000), minute(8)), (minute(25_000), minute(25_500))]
    rows += [(minute(25_400), minute(3)), (minute(26_000), minute(30_000)), (minute(27_000), minute(1))]
    assert merged(spark, rows, block_chars=chars, large_owner=large) == fold(rows)


def test_merge_documented_cases(spark):
    assert merged(spark, [("1", "3"), ("3", "9")]) == [("1", "9")]
    assert merged(spark, [("1", "9"), ("2", "4")]) == [("1", "9")]
    assert merged(spark, [("1", "2"), ("3", "4")]) == [("1", "2"), ("3", "4")]
    assert merged(spark, []) == []


@pytest.mark.parametrize("large", [1 << 20, 45, 5])
def test_merge_keeps_owners_apart(spark, large):
    rows = [(o, s, e) for o, n in (("x", 60), ("y", 30)) for s, e in sample(ord(o), n, 5_000)]
    df = spark.createDataFrame(rows, "subject string, start string, end string")
    found = {}
    for r in merge_intervals(df, by=["subject"], large_owner=large).collect():
        found.setdefault(r.subject, []).extend([(r.start, r.end)] * r.copies)
    for o in "xy":
        assert sorted(found[o]) == fold([(s, e) for w, s, e in rows if w == o])


@pytest.mark.parametrize("levels", [(10, 13, 19), (10,), (4, 7, 10, 13, 16, 19)])
@pytest.mark.parametrize("seed", [5, 6])
def test_overlap_equals_the_rule(spark, seed, levels):
    windows = fold(sample(seed, 40, 20_000))
    records = [(i, *w) for i, w in enumerate(sample(seed + 50, 500, 25_000))]
    records += [(1000, None, minute(5)), (1001, minute(5), None), (1002, "", minute(9)), (1003, minute(1), minute(40_000))]
    w = spark.createDataFrame(windows, "start string, end string")
    r = spark.createDataFrame(records, "id int, start string, end string")
    found = sorted(x.id for x in interval_overlap(r, w, levels=levels).collect())
    assert found == sorted(i for i, s, e in records if overlaps(windows, s, e))


def test_overlap_documented_cases(spark):
    w = spark.createDataFrame([("1", "9"), ("20", "30")], "start string, end string")
    r = spark.createDataFrame([(1, "8", "2"), (2, "9", "9"), (3, "91", "92"), (4, "0", "1")], "id int, start string, end string")
    assert sorted(x.id for x in interval_overlap(r, w).collect()) == [1, 2, 4]


def test_many_windows_in_one_hour(spark):
    n = 100_000
    at = F.concat(F.lit("2024-01-01 10:"), F.format_string("%02d:%09.6f", (F.col("id") * 30_000 / 6e7).cast("int"), (F.col("id") * 30_000 % 60_000_000) / 1e6))
    points = spark.range(n).select("id", at.alias("start"))
    windows = points.filter("id % 3 = 0").select("start", F.col("start").alias("end"))
    records = points.withColumn("end", F.col("start"))
    kept = interval_overlap(records, windows)
    assert kept.count() == kept.filter("id % 3 = 0").count() == windows.count()
    assert "NestedLoop" not in kept._jdf.queryExecution().toString()


def test_forced_types(spark):
    w = spark.createDataFrame([("1", "3")], "start string, end string")
    r = spark.createDataFrame(
        [(1, "HR", "2", "2"), (2, "Steps", "8", "9"), (3, "Steps", None, None), (4, None, "2", "5"), (5, "HR", "7", "8")],
        "id int, type string, start string, end string",
    )
    assert sorted(x.id for x in keep_records(r, w, force_types=["Steps"]).collect()) == [1, 2, 3, 4]
    assert sorted(x.id for x in keep_records(r, w).collect()) == [1, 4]


@pytest.mark.parametrize("many", [1 << 16, 3])
def test_children_are_taken_off_once(spark, many):
    records = [("s", "Sys", "1", "2")] * 2 + [("s", "HR", "1", None)] * 10 + [("t", "HR", "1", None)]
    r = spark.createDataFrame(records, "subject string, type string, start string, end string")
    kind = "subject string, Record array<struct<type:string,start:string,end:string>>, end string"
    p = spark.createDataFrame(
        [("s", [("Sys", "1", "2")], "9"), ("s", [("HR", "1", None), ("HR", "1", None), ("No", "1", None)], None), ("s", None, None)], kind
    )
    left = [tuple(x) for x in top_level(r, p, "Record", ["subject"], many).collect()]
    assert sorted(left, key=str) == sorted([records[0]] + [records[2]] * 8 + [records[-1]], key=str)


def test_children_take_no_attribute_of_their_parent(spark):
    r = spark.createDataFrame([("s", "HR", "watch"), ("s", "Sys", None), ("s", "Sys", "cuff")], "subject string, type string, device string")
    p = spark.createDataFrame([("s", "cuff", [("Sys",)])], "subject string, device string, Record array<struct<type:string>>")
    left = {tuple(x) for x in top_level(r, p, "Record", ["subject"]).collect()}
    assert left == {("s", "HR", "watch"), ("s", "Sys", "cuff")}


@pytest.mark.parametrize("large", [1 << 20, 30, 3])
@pytest.mark.parametrize("by", [[], ["subject"]])
def test_ranges_of_large_owners_do_not_matter(spark, monkeypatch, large, by):
    """Blocks of four rows in several ranges give what one window gives."""
    monkeypatch.setattr("recordloom.operators.ordered.in_blocks.__defaults__", (2,))
    rows = [(o, s, e) for o, n in (("x", 80), ("y", 25)) for s, e in sample(ord(o), n, 4_000)]
    if not by:
        rows = [("x", s, e) for _, s, e in rows]
    df = spark.createDataFrame(rows, "subject string, start string, end string")
    windows = merge_intervals(df, by, large_owner=large)
    found = {}
    for r in windows.withColumn("owner", F.col("subject") if by else F.lit("x")).collect():
        found.setdefault(r.owner, []).extend([(r.start, r.end)] * r.copies)
    want = {o: fold([(s, e) for w, s, e in rows if w == o]) for o in {r[0] for r in rows}}
    assert {o: sorted(v) for o, v in found.items()} == want
    records = [(i, o, *w) for i, (o, w) in enumerate((o, w) for o in want for w in sample(ord(o) + 9, 200, 5_000))]
    r = spark.createDataFrame(records, "id int, subject string, start string, end string")
    kept = interval_overlap(r, windows, by, large_owner=large)
    assert sorted(x.id for x in kept.collect()) == sorted(i for i, o, s, e in records if overlaps(want[o], s, e))


def test_windows_of_one_hour_are_merged_in_several_tasks(spark):
    from recordloom.operators.ordered import in_blocks

    n = 200_000
    at = F.concat(F.lit("2024-01-01 10:"), F.format_string("%02d:%09.6f", (F.col("id") * 15_000 / 6e7).cast("int"), (F.col("id") * 15_000 % 60_000_000) / 1e6))
    windows = spark.range(n).select(at.alias("start")).withColumn("end", F.col("start"))
    assert merge_intervals(windows, large_owner=1000).count() == n
    sizes = [r["count"] for r in in_blocks(windows, [], ["start"]).groupBy("_block").count().collect()]
    assert max(sizes) <= 1 << 16 and len(sizes) >= 4
