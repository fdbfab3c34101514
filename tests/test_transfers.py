import random

import pytest

from recordloom.operators import transfers
from recordloom.operators.transfers import cancel_transfers, rounds

COLUMNS = "owner string, ord long, date string, amount double, account_id string"


def brute_force(rows):
    """The rule row by row: each positive takes the first unused negative of another account."""
    gone = set()
    for _, ord_, date, amount, account in sorted(rows, key=lambda r: r[1]):
        if amount is None or amount <= 0:
            continue
        for _, other, d, a, acc in sorted(rows, key=lambda r: r[1]):
            if other not in gone and d == date and a == -amount and acc != account:
                gone |= {ord_, other}
                break
    return sorted(r[1] for r in rows if r[1] not in gone)


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, COLUMNS)
    return sorted(r.ord for r in cancel_transfers(df, **options).select("ord").collect())


def test_documented_cases(spark):
    rows = [
        ("o", 0, "2025-01-17", 2300.0, "a"),
        ("o", 1, "2025-01-17", -2300.0, "b"),  # the pair
        ("o", 2, "2025-01-18", 10.0, "a"),
        ("o", 3, "2025-01-18", -10.0, "a"),  # one account only
        ("o", 4, "2025-01-19", 7.0, "a"),
        ("o", 5, "2025-01-19", 7.0, "a"),
        ("o", 6, "2025-01-19", -7.0, "b"),  # the first positive is taken
        ("o", 7, "2025-01-20", 0.0, "a"),
        ("o", 8, "2025-01-20", 0.0, "b"),
        ("o", 9, "2025-01-21", 5.0, "a"),
        ("o", 10, "2025-01-22", -5.0, "b"),  # a day apart
    ]
    assert run(spark, rows) == [2, 3, 5, 7, 8, 9, 10] == brute_force(rows)


def sample(seed, accounts, n, shares=None):
    rnd = random.Random(seed)
    names = "abcdefgh"[:accounts]
    return [
        (
            "o",
            i * 3,
            f"2025-01-0{rnd.randint(1, 3)}",
            rnd.choice([-5.0, 5.0, -7.5, 7.5, 0.0]),
            rnd.choices(names, weights=shares)[0],
        )
        for i in range(n)
    ]


@pytest.mark.parametrize("seed,accounts", [(1, 1), (2, 2), (3, 3), (4, 4), (5, 8)])
def test_equals_the_rule(spark, seed, accounts):
    rows = sample(seed, accounts, 400)
    assert run(spark, rows) == brute_force(rows)


@pytest.mark.parametrize("block,chunk", [(16, 4), (50, 16)])
@pytest.mark.parametrize("shares", [[1, 1, 1], [6, 1, 1], [1, 8, 8], [10, 9, 1]])
def test_one_large_bucket_split_into_blocks_and_chunks(spark, block, chunk, shares):
    rows = [(o, i, "2025-01-01", a and (9.0 if a > 0 else -9.0), acc) for o, i, _, a, acc in sample(7, 3, 500, shares)]
    assert run(spark, rows, block=block, chunk=chunk) == brute_force(rows)


def test_long_runs_of_one_account(spark):
    rows, accounts = [], ["a"] * 40 + ["b"] * 70 + ["c"] * 30 + ["a"] * 60
    for i, account in enumerate(accounts * 2):
        rows.append(("o", i, "2025-01-01", 3.0 if (i // 25) % 2 else -3.0, account))
    assert run(spark, rows, block=32, chunk=8) == brute_force(rows)


def test_owners_do_not_mix(spark):
    rows = []
    for owner, seed in (("x", 11), ("y", 12)):
        rows += [(owner, i + (0 if owner == "x" else 10_000), d, a, acc) for _, i, d, a, acc in sample(seed, 3, 120)]
    expected = sorted(
        brute_force([r for r in rows if r[0] == "x"]) + brute_force([r for r in rows if r[0] == "y"])
    )
    assert run(spark, rows, by=["owner"]) == expected


def test_large_bucket_without_transfers_and_rows_without_amount(spark):
    rows = [("o", i, "2025-01-01", 4.0, "a") for i in range(50)]
    rows += [("o", 100 + i, "2025-01-01", 0.0, "ab"[i % 2]) for i in range(50)]
    rows += [("o", 200 + i, "2025-01-01", None, "ab"[i % 2]) for i in range(50)]
    rows += [("o", 300, "2025-01-01", 0.001, "a"), ("o", 301, "2025-01-01", -0.001, "b")]
    assert run(spark, rows, block=16) == [r[1] for r in rows if r[1] < 300]


@pytest.mark.parametrize("kind", ["string", "int", "long"])
def test_long_buckets_end_for_any_type_of_account(spark, kind):
    rows = [(i, "2024-01-01", 5.0 if (i * 7) % 5 < 2 else -5.0, (i * 11) % 3) for i in range(300)]
    rows.append((300, "2024-01-01", float("nan"), 1))
    df = spark.createDataFrame(rows, "ord long, date string, amount double, account_id long")
    df = df.withColumn("account_id", df["account_id"].cast(kind))
    short = sorted(r.ord for r in cancel_transfers(df).collect())
    long = sorted(r.ord for r in cancel_transfers(df, block=64, chunk=16).collect())
    assert short == long and 300 in short


def test_rounds_are_bounded():
    assert [rounds(n) for n in (1, 2, 3, 1000, 2**40)] == [1, 2, 2, 10, 41]


def test_no_python_where_buckets_are_long(spark):
    df = spark.createDataFrame(sample(3, 3, 200), COLUMNS)
    plan = cancel_transfers(df, block=16, chunk=4)._jdf.queryExecution().toString()
    assert "Python" not in plan and "FlatMapGroups" not in plan


@pytest.mark.parametrize("turns", [0, 1, 2, 30])
@pytest.mark.parametrize("shares", [[1, 1, 1, 1], [9, 1, 1, 1], [6, 6, 1, 1]])
def test_turns_over_summaries_do_not_matter(spark, monkeypatch, turns, shares):
    """However few turns are allowed, what is left open is found by doubling."""
    original = transfers._fold_summaries

    def limited(pairs, bucket, chunk, kind, _):
        return original(pairs, bucket, chunk, kind, turns)

    monkeypatch.setattr(transfers, "_fold_summaries", limited)
    rows = [(o, i, "2025-01-01", a and (9.0 if a > 0 else -9.0), acc) for o, i, _, a, acc in sample(sum(shares), 4, 600, shares)]
    rows += [("p", 9000 + i, d, a, acc) for _, i, d, a, acc in sample(2, 3, 60)]
    assert run(spark, rows, by=["owner"], block=64, chunk=16) == sorted(
        brute_force([r for r in rows if r[0] == "o"]) + brute_force([r for r in rows if r[0] == "p"])
    )


def test_buckets_of_too_many_chunks_are_doubled(spark, monkeypatch):
    monkeypatch.setattr(transfers, "MOST_CHUNKS", 3)
    rows = [(o, i, "2025-01-01", a and (9.0 if a > 0 else -9.0), acc) for o, i, _, a, acc in sample(5, 3, 300)]
    assert run(spark, rows, block=64, chunk=16) == brute_force(rows)
