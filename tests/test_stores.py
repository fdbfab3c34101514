"""Stored tables: what an import reads, writes and leaves alone."""

import random
from pathlib import Path

import pytest

from recordloom.operators.summary import annual_summary, partial_sums, summary_of_sums
from recordloom.plans import ledger_import as L
from recordloom.plans.sheet_import import all_returns, analyze, import_sheets, returns_path
from recordloom.sources.tables import Keyed, bucket_versions, mark, marked, read_snapshot, replace_in_buckets, write_snapshot

ROWS = "ord long, date string, description string, normalized_description string, amount double, subtype string, category string, account_id string, source_file string"


def batch(spark, seed, n=60, day=None):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = rng.choice("abc")
        amount = rng.choice([1.5, -2.25, 0.0, -0.0, 1e300, 0.1])
        rows.append((i, day or f"202{rng.randrange(4)}-01-0{rng.randrange(1, 9)}", text, text.upper(), amount, "", "t", rng.choice(["x", None]), f"f{seed}"))
    return spark.createDataFrame(rows, ROWS)


def figures(df):
    return sorted((tuple(r) for r in df.drop("computed_at").collect()), key=repr)


def same(got, want):
    """Equal rows; sums of doubles that no decimal holds may differ in their last bit."""
    got, want = figures(got), figures(want)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    return all(g[3:] == pytest.approx(w[3:]) for g, w in zip(got, want))


def files(path):
    return {str(p): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def test_sums_of_batches_are_the_summary_of_all_rows(spark):
    parts = [batch(spark, i) for i in range(3)]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    sums = partial_sums(parts[0]).unionByName(partial_sums(parts[1])).unionByName(partial_sums(parts[2]))
    want, got = figures(annual_summary(every)), figures(summary_of_sums(sums))
    assert [w[:3] for w in want] == [g[:3] for g in got] and len(want) > 10
    for w, g in zip(want, got):
        assert w[3:] == pytest.approx(g[3:])


def test_import_adds_to_the_sums_and_joins_without_shuffling_what_is_stored(spark, tmp_path):
    store = str(tmp_path / "store")
    for seed in (1, 2, 1):
        inserted = L.import_batch(batch(spark, seed), store, buckets=4).first().inserted
    # Rows without account equal nothing, so they come in again; the others do not.
    again = batch(spark, 1).filter("account_id is null").count()
    assert inserted == again
    stored = spark.read.parquet(L.transactions_path(store))
    assert same(L.read_analysis(spark, store), annual_summary(stored))
    before = files(L.transactions_path(store))
    table = Keyed(spark, L.transactions_path(store))
    fresh = L._fresh(batch(spark, 3), table, ())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = fresh._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "LeftAnti" in plan and "Bucketed: true" in plan
    assert plan.count("Exchange hashpartitioning(row_key") == 1  # of the batch
    assert files(L.transactions_path(store)).items() >= before.items()


def test_a_broken_import_is_made_good(spark, tmp_path):
    store = str(tmp_path / "store")
    L.import_batch(batch(spark, 1), store, buckets=3)
    # Rows came in, their sums did not.
    table = Keyed(spark, L.transactions_path(store))
    table.append(L._fresh(batch(spark, 2), table, ()).selectExpr("*", "current_timestamp() as imported_at"))
    mark(spark, L._open_path(store))
    L.import_batch(batch(spark, 3), store)
    assert not marked(spark, L._open_path(store))
    assert same(L.read_analysis(spark, store), annual_summary(spark.read.parquet(L.transactions_path(store))))


def test_a_store_from_before_there_were_buckets_goes_on(spark, tmp_path):
    store = str(tmp_path / "store")
    batch(spark, 1).write.parquet(L.transactions_path(store))
    assert L.import_batch(batch(spark, 2), store).first().inserted > 0
    stored = spark.read.parquet(L.transactions_path(store))
    assert same(L.read_analysis(spark, store), annual_summary(stored))


KIND = "filer string, tax_year int, db_col string, value double"


def test_other_buckets_stay_as_they_are(spark, tmp_path):
    path = str(tmp_path / "t")
    first = [(f"f{i}", y, "a", float(i)) for i in range(30) for y in (2020, 2021)]
    replace_in_buckets(spark.createDataFrame(first, KIND), path, ["tax_year"], ["filer"], buckets=8)
    before, held = files(path), bucket_versions(spark, path)
    changed = replace_in_buckets(spark.createDataFrame([("f3", 2021, "b", 9.0)], KIND), path, ["tax_year"], ["filer"])
    after = bucket_versions(spark, path)
    assert len(changed) == 1 and len(after) == 8
    assert {b for b in after if after[b] != held[b]} == set(changed) == {b for b in after if after[b] == 2}
    assert files(path).items() >= before.items()
    new = set(files(path)) - set(before)
    assert all(f"bucket={changed[0]}/" in f for f in new if "/buckets/" not in f)
    rows = {tuple(r) for r in read_snapshot(spark, path).select("filer", "tax_year", "db_col", "value").collect()}
    assert rows == {r for r in first if r[:2] != ("f3", 2021)} | {("f3", 2021, "b", 9.0)}


def test_an_unlisted_version_counts_for_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    replace_in_buckets(spark.createDataFrame([("x", 2020, "a", 1.0)], KIND), path, ["tax_year"], ["filer"], buckets=2)
    spark.createDataFrame([("y", 2020, "a", 5.0)], KIND).selectExpr("*", "0 as bucket").write.partitionBy("bucket").parquet(f"{path}/v=000002")
    assert read_snapshot(spark, path).count() == 1
    replace_in_buckets(spark.createDataFrame([("x", 2020, "a", 2.0)], KIND), path, ["tax_year"], ["filer"])
    assert [r.value for r in read_snapshot(spark, path).collect()] == [2.0]


def test_a_table_stored_whole_is_taken_into_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    write_snapshot(spark.createDataFrame([("x", 2020, "a", 1.0), ("y", 2020, "a", 2.0)], KIND), path)
    replace_in_buckets(spark.createDataFrame([("y", 2020, "a", 3.0)], KIND), path, ["tax_year"], ["filer"], buckets=4)
    assert sorted((r.filer, r.value) for r in read_snapshot(spark, path).collect()) == [("x", 1.0), ("y", 3.0)]


def sheet(tmp_path, name, text):
    (tmp_path / name).parent.mkdir(exist_ok=True)
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_many_sheets_of_a_filer_in_one_job(spark, tmp_path):
    store, paths = str(tmp_path / "store"), []
    for i in range(5):
        paths.append(sheet(tmp_path, f"s{i}.csv", f"Form,Line,Description,{2020 + i},2021\nA,{i},x,{i},{10 + i}\n"))
    spark.sparkContext.setJobGroup("five", "five sheets")
    import_sheets(spark, paths, store)
    spark.sparkContext.setJobGroup("one", "one sheet")
    import_sheets(spark, paths[:1], str(tmp_path / "alone"))
    tracker = spark.sparkContext.statusTracker()
    # A reading per distinct header, of which there are four more, but no write per sheet.
    assert len(tracker.getJobIdsForGroup("five")) <= len(tracker.getJobIdsForGroup("one")) + 4
    one_by_one = str(tmp_path / "turns")
    for path in paths:
        import_sheets(spark, [path], one_by_one)

    def content(where):
        return sorted((r.tax_year, r.db_col, r.value) for r in read_snapshot(spark, returns_path(where)).collect())

    assert content(store) == content(one_by_one)
    assert [r for r in content(store) if r[0] == 2021] == [(2021, "f_a_4", 14.0)]


def test_years_without_usable_lines_are_stored(spark, tmp_path):
    """They replace a stored year whole, and the next year is compared with them."""
    store = str(tmp_path / "store")
    full = sheet(tmp_path, "a.csv", "Form,Line,Description,2020,2021,2022\n1040,24,x,10,20,30\n")
    empty = sheet(tmp_path, "b.csv", "Form,Line,Description,2021\n0,0,Means,y\n")
    none = sheet(tmp_path, "c.csv", "Form,Line,Description,2019\n")
    import_sheets(spark, [full, empty, none], store)
    wide = all_returns(spark, store, ["f_1040_24"]).collect()
    assert [(r.tax_year, r.f_1040_24) for r in wide] == [(2019, None), (2020, 10.0), (2021, None), (2022, 30.0)]
    table = analyze(spark, [full], store).orderBy("tax_year").collect()
    assert [(r.tax_year, r.yoy_f_1040_24_pct) for r in table] == [(2019, None), (2020, None), (2021, None), (2022, None)]
    from recordloom.operators.sheet import yoy_change

    changes = yoy_change(read_snapshot(spark, returns_path(store)), None, ["filer"]).collect()
    assert sorted((r.tax_year, r.yoy_pct) for r in changes) == [(2020, None), (2022, None)]
