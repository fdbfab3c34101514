"""Every registered query against its SQL on the small tables, and rules for the registry."""

import pytest
from check_queries import compare, database

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_same_as_sql(spark, con, name):
    assert compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), FOLDER) == []


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_filters_and_columns_reach_the_scan(spark):
    plan = entry.queries()["top_level_elements"](spark, FOLDER)._jdf.queryExecution().toString()
    assert "props" not in plan[plan.index("== Physical Plan") :]
    plan = entry.queries()["interval_overlap"](spark, FOLDER)._jdf.queryExecution().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "events.parquet" in line)
    assert "NOT (event_type" in scan and "props" not in scan


def test_no_python_in_the_plans(spark):
    for name in ("ledger_summary", "interval_overlap", "repo_report", "analysis_table", "merge_replace"):
        plan = entry.queries()[name](spark, FOLDER)._jdf.queryExecution().toString()
        assert "Python" not in plan and "FlatMapGroups" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("name", ["pivot_returns", "yoy_change", "pivot_yoy", "analysis_table", "analysis_report", "import_sheets"])
def test_new_years_and_priorities_keep_their_rows(spark, tmp_path, name):
    """Orders of later years and of a priority that nobody listed are fields and years like others."""
    import shutil

    import pyarrow as pa
    import pyarrow.compute as pc
    import pyarrow.parquet as pq
    from check_queries import TABLES

    for table in TABLES:
        shutil.copyfile(f"{FOLDER}/{table}.parquet", tmp_path / f"{table}.parquet")
    orders = pq.read_table(f"{FOLDER}/orders.parquet")
    odd = pc.equal(pc.bit_wise_and(orders["o_orderkey"], 3), 0)
    day = orders["o_orderdate"]
    later = pc.add(day.cast(pa.timestamp("us")), pa.scalar(10 * 365 * 86_400 * 10**6, pa.duration("us"))).cast(day.type)
    columns = {"o_orderpriority": pc.if_else(odd, "6-Brand New", orders["o_orderpriority"]), "o_orderdate": pc.if_else(odd, later, day)}
    for column, values in columns.items():
        orders = orders.set_column(orders.schema.get_field_index(column), column, values)
    pq.write_table(orders, tmp_path / "orders.parquet")
    con = database(str(tmp_path))
    assert compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], str(tmp_path)) == []
    df = entry.queries()[name](spark, str(tmp_path))
    if name == "analysis_report":
        assert {"y2005", "y2008"} <= set(df.columns)
    elif name != "yoy_change":
        assert any("6_brandnew" in c for c in df.columns)
