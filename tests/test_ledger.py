from recordloom.operators.merge import import_counts, merge_ignore, merge_replace
from recordloom.plans.ledger_import import import_batch, import_ledgers, read_analysis, transactions_path
from recordloom.sources.ledger_files import scan_ledgers

A = '''Transaction date,Description,Type,Amount
1/17/2025,Transfer from bank,Deposit,"2,300.00"
01/18/2025,Venmo-Payment-00000000,Withdrawal,-45.10
1/19/2025,"two
lines, ""quoted""",Withdrawal,nan
'''
A_MORE = """Note,TRANSACTION DATE,Description,Type,Amount
x,1/20/2025,Cafe XXXX1234,Debit,-3
"""
B = """Transaction Date,Transaction Description,Transaction Type,Debit,Credit,Balance
01/17/2025,Transfer out,Debit,"$2,300.00",0,"$5,000.00"
01/20/2025,Interest,Credit,0,$1.25,"$5,001.25"
01/20/2025,Interest,Credit,0,$1.25,"$5,001.25"
"""


def files(folder):
    paths = []
    for name, text in (("a b.csv", A), ("more.csv", A_MORE), ("b.csv", B), ("bad.csv", "x,y\n1,2\n"), ("empty.csv", ""), ("only.csv", B.split("\n")[0] + "\n")):
        (folder / name).write_text(text)
        paths.append(str(folder / name))
    return [*paths, str(folder / "missing.csv")]


def test_scan_reads_both_layouts_in_order(spark, tmp_path):
    scan = scan_ledgers(spark, files(tmp_path))
    rows = scan.transactions.orderBy("ord").collect()
    assert [(r.date, r.normalized_description, r.amount, r.subtype, r.account_id, r.source_file) for r in rows] == [
        ("2025-01-17", "Transfer From Bank", 2300.0, "Deposit", "wealthfront", "a b.csv"),
        ("2025-01-18", "Venmo Payment", -45.1, "Withdrawal", "wealthfront", "a b.csv"),
        ("2025-01-19", 'Two\nLines, "Quoted"', None, "Withdrawal", "wealthfront", "a b.csv"),
        # The header is recognised in any case, but values are looked up by exact name.
        ("", "Cafe", -3.0, "Debit", "wealthfront", "more.csv"),
        ("2025-01-17", "Transfer Out", -2300.0, "Debit", "discover", "b.csv"),
        ("2025-01-20", "Interest", 1.25, "Credit", "discover", "b.csv"),
        ("2025-01-20", "Interest", 1.25, "Credit", "discover", "b.csv"),
    ]
    refused = {r.path.rsplit("/", 1)[-1]: r.reason for r in scan.rejected.collect()}
    assert set(refused) == {"bad.csv", "empty.csv", "missing.csv"}


def test_scan_in_pieces_keeps_the_order(spark, tmp_path):
    lines = ["Transaction date,Description,Type,Amount"] + [f"1/1/2025,d{i},t,{i}" for i in range(5000)]
    (tmp_path / "big.csv").write_text("\n".join(lines))
    (tmp_path / "next.csv").write_text(A.split("\n")[0] + "\n1/1/2025,last,t,5000\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        scan = scan_ledgers(spark, [str(tmp_path / "big.csv"), str(tmp_path / "next.csv")], multi_line=False)
        assert scan.transactions.rdd.getNumPartitions() > 4
        assert [r.amount for r in scan.transactions.orderBy("ord").collect()] == [float(i) for i in range(5001)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_import_twice_adds_nothing(spark, tmp_path):
    paths, store = files(tmp_path), str(tmp_path / "store")
    first, report = import_ledgers(spark, paths, store)
    # 7 rows: the transfer goes, the equal row and the row without amount are skipped.
    assert first.drop("analysis_rows").first().asDict() == {"parsed": 7, "cancelled": 2, "inserted": 3, "skipped": 2}
    assert {r.source_file: r.parsed for r in report.collect() if r.parsed} == {"a b.csv": 3, "more.csv": 1, "b.csv": 3}
    again, _ = import_ledgers(spark, paths, store)
    assert again.first().inserted == 0 and again.first().skipped == 5
    assert spark.read.parquet(transactions_path(store)).count() == 3
    summary = {(r.year, r.group_type, r.group_value): (r.total_income, r.total_spend, r.net, r.txn_count) for r in read_analysis(spark, store).collect()}
    assert summary == {
        ("2025", "total", "all"): (1.25, -45.1, -43.85, 2),
        ("2025", "description", "Venmo Payment"): (0.0, -45.1, -45.1, 1),
        ("2025", "description", "Interest"): (1.25, 0.0, 1.25, 1),
        ("2025", "source_file", "a b.csv"): (0.0, -45.1, -45.1, 1),
        ("2025", "source_file", "b.csv"): (1.25, 0.0, 1.25, 1),
        ("", "total", "all"): (0.0, -3.0, -3.0, 1),
        ("", "description", "Cafe"): (0.0, -3.0, -3.0, 1),
        ("", "source_file", "more.csv"): (0.0, -3.0, -3.0, 1),
    }


def test_nothing_to_import(spark, tmp_path):
    counts, report = import_ledgers(spark, [str(tmp_path / "none.csv")], str(tmp_path / "store"))
    assert counts is None and report.count() == 1


def test_transfer_in_two_batches_stays(spark, tmp_path):
    columns = "ord long, date string, description string, normalized_description string, amount double, subtype string, category string, account_id string, source_file string"
    store = str(tmp_path / "store")
    for ord_, amount, account in ((0, 5.0, "x"), (1, -5.0, "y")):
        row = (ord_, "2025-01-01", "d", "D", amount, "", "transaction", account, "f")
        assert import_batch(spark.createDataFrame([row], columns), store).first().inserted == 1
    assert spark.read.parquet(transactions_path(store)).count() == 2


def test_owners_share_a_store(spark, tmp_path):
    (tmp_path / "x.csv").write_text(A)
    (tmp_path / "y.csv").write_text(B)
    paths = [str(tmp_path / n) for n in ("x.csv", "y.csv")]
    counts, _ = import_ledgers(spark, paths, str(tmp_path / "s"), owner_of=lambda p: p.rsplit("/", 1)[-1])
    assert counts.first().cancelled == 0 and counts.first().inserted == 4


def test_merge_ignore(spark):
    columns = "ord long, date string, description string, amount double, account_id string"
    stored = spark.createDataFrame([(0, "d1", "x", 1.0, "a")], columns)
    batch = spark.createDataFrame(
        [(5, "d1", "x", 1.0, "a"), (6, "d1", "x", 1.0, "b"), (7, "d1", "x", 1.0, "b"), (8, "d2", "x", None, "a"), (9, "d1", "x", 1.0, None), (10, "d1", "x", 1.0, None)],
        columns,
    )
    fresh = merge_ignore(batch, stored)
    assert sorted(r.ord for r in fresh.collect()) == [6, 9, 10]
    assert import_counts(batch, fresh).first().asDict() == {"inserted": 3, "skipped": 3}


def test_merge_replace_wide(spark):
    stored = spark.createDataFrame([(2020, 1.0, 2.0), (2021, 3.0, 4.0)], "tax_year int, a double, b double")
    new = spark.createDataFrame([(2021, 9.0, 7.0)], "tax_year int, a double, c double")
    found = sorted(tuple(r) for r in merge_replace(stored, new).select("tax_year", "a", "b", "c").collect())
    assert found == [(2020, 1.0, 2.0, None), (2021, 9.0, None, 7.0)]


def test_dedup_is_trimmed_before_the_shuffle(spark, capsys):
    text = "cast(id % 7 as string)"
    df = spark.range(100).selectExpr("id as ord", f"{text} as date", f"{text} as description", "cast(id % 3 as double) as amount", f"{text} as account_id")
    merge_ignore(df, None).explain()
    plan = capsys.readouterr().out
    assert "Partial" in plan[plan.index("Exchange") :] and "WindowGroupLimit" in plan


def test_headers_of_large_files_read_little(spark, tmp_path, monkeypatch):
    """The first line is found without reading the file: bytes read stay far below its size."""
    from recordloom.sources import csv_files

    line = "x" * 90 + ",1\n"
    (tmp_path / "big.csv").write_text("\ufeffone,two\n" + line * 600_000)
    (tmp_path / "next.csv").write_text("three,four\n" + line * 50_000)
    (tmp_path / "small.csv").write_text("five\n1\n")
    paths = [str(tmp_path / n) for n in ("big.csv", "small.csv", "none.csv", "next.csv")]
    store = spark.sparkContext._jsc.sc().statusStore()
    before = sum(store.executorList(False).apply(i).totalInputBytes() for i in range(store.executorList(False).size()))
    found = csv_files.find_files(spark, paths)
    assert [f.header for f in found] == ["one,two", "five", "", "three,four"]
    after = sum(store.executorList(False).apply(i).totalInputBytes() for i in range(store.executorList(False).size()))
    assert after - before < 8 << 20
    monkeypatch.setattr(csv_files, "WHOLE_BYTES", 1)
    assert [f.header for f in csv_files.find_files(spark, paths)] == ["one,two", "five", "", "three,four"]
