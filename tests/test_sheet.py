import pytest

from recordloom.operators import sheet as S
from recordloom.operators.merge import merge_replace
from recordloom.plans.sheet_import import all_returns, analyze, import_sheets, returns_path
from recordloom.sources.sheet_files import scan_sheets
from recordloom.sources.tables import read_snapshot, versions

SHEET = """Form,Line,Description,2021,2022,2024
0,0,Means,HR Block,HR Block,Other
1040,15,Taxable income,"$100,000","$110,000",NA
1040,24,Total tax,"$20,000",(500),"$30,000"
D,7,Net short term gain,-,0,5
,,,1,2,3
"""


def long(df, *keys):
    return {tuple(r[k] for k in keys): r.value for r in df.collect()}


def write(folder, name, text, **kind):
    (folder / name).write_text(text, **kind)
    return str(folder / name)


def test_unpivot(spark, tmp_path):
    rows = scan_sheets(spark, [write(tmp_path, "s.csv", SHEET, encoding="utf-8-sig")]).rows
    assert long(S.unpivot_sheet(rows), "tax_year", "db_col") == {
        (2021, "f_1040_15"): 100000.0,
        (2022, "f_1040_15"): 110000.0,
        (2024, "f_1040_15"): None,
        (2021, "f_1040_24"): 20000.0,
        (2022, "f_1040_24"): -500.0,
        (2024, "f_1040_24"): 30000.0,
        (2021, "f_d_7"): None,
        (2022, "f_d_7"): 0.0,
        (2024, "f_d_7"): 5.0,
    }
    fields = sorted(tuple(r) for r in S.sheet_fields(rows).collect())
    assert fields[0] == ("f_1040_15", "Taxable income", "1040", "15") and len(fields) == 3


def test_odd_headers(spark, tmp_path):
    text = "Form,Line,Year, 2023,2022,2022\nA,1,one,1,2,3\nA,1.,again,4,5\n"
    rows = scan_sheets(spark, [write(tmp_path, "odd.csv", text)]).rows
    assert long(S.unpivot_sheet(rows), "tax_year", "db_col") == {(2023, "f_a_1"): 4.0, (2022, "f_a_1"): None}
    assert S.sheet_fields(rows).first().description == "again"
    assert S.field_collisions(rows).first().n == 2


def test_no_years_and_no_form(spark, tmp_path):
    scan = scan_sheets(spark, [write(tmp_path, "n.csv", "Form,Line,What\nA,1,x\n"), write(tmp_path, "f.csv", "Line,2020\n1,2\n")])
    assert S.unpivot_sheet(scan.rows).count() == 0
    assert S.sheet_fields(scan.rows).first().description == "x"
    assert [r.path.rsplit("/", 1)[-1] for r in scan.rejected.collect()] == ["f.csv"]


def test_wide_frame_as_sheet(spark):
    df = spark.createDataFrame([(1, "A", "1", "x", "5", "6")], "ord int, Form string, Line string, Note string, `2020` string, `2021` string")
    assert long(S.unpivot_sheet(S.sheet_rows(df)), "tax_year") == {(2020,): 5.0, (2021,): 6.0}
    with pytest.raises(ValueError):
        S.sheet_rows(df.drop("Form"))


RETURNS = [
    ("x", 2020, "f_a", 100.0),
    ("x", 2020, "f_b", 0.0),
    ("x", 2020, "f_c", -5.0),
    ("x", 2021, "f_a", 150.0),
    ("x", 2021, "f_b", 3.0),
    ("x", 2021, "f_c", None),
    ("x", 2023, "f_a", 75.0),
    ("x", 2023, "f_c", 10.0),
    ("y", 2021, "f_a", 1.0),
]


def test_yoy(spark):
    returns = spark.createDataFrame(RETURNS, "filer string, tax_year int, db_col string, value double")
    found = {(r.filer, r.tax_year, r.db_col): r.yoy_pct for r in S.yoy_change(returns, ["f_a", "f_b", "f_c"], ["filer"]).collect()}
    assert len(found) == 12
    expected = {("x", 2021, "f_a"): 50.0, ("x", 2023, "f_a"): -50.0}
    assert {k: v for k, v in found.items() if v is not None} == expected
    wide = {(r.filer, r.tax_year): (r.yoy_f_a_pct, r.yoy_f_c_pct) for r in S.pivot_yoy(S.yoy_change(returns, None, ["filer"]), ["f_a", "f_c"], ["filer"]).collect()}
    assert wide[("x", 2023)] == (-50.0, None)


def test_ratios(spark):
    rows = [(2020, "f_1040_24", 20.0), (2020, "f_1040_15", 100.0), (2020, "f_d_7", 3.0), (2020, "f_d_15", 0.0), (2021, "f_540_64", 1.0)]
    found = S.derived_ratios(spark.createDataFrame(rows, "tax_year int, db_col string, value double")).orderBy("tax_year").collect()
    assert [tuple(r) for r in found] == [(2020, 20.0, None, None), (2021, None, None, None)]


def test_replace_whole_years(spark):
    kind = "tax_year int, db_col string, value double"
    stored = spark.createDataFrame([(2020, "a", 1.0), (2021, "a", 2.0), (2021, "b", 3.0)], kind)
    new = spark.createDataFrame([(2021, "a", 9.0)], kind)
    assert long(merge_replace(stored, new), "tax_year", "db_col") == {(2020, "a"): 1.0, (2021, "a"): 9.0}


def test_import_and_analyze(spark, tmp_path):
    store = str(tmp_path / "store")
    sheet = write(tmp_path, "s.csv", SHEET)
    assert analyze(spark, [sheet], store) is None and all_returns(spark, store, []) is None
    assert import_sheets(spark, [sheet], store).count() == 0
    later = write(tmp_path, "t.csv", "Form,Line,Description,2024\n1040,24,Total tax,60\n")
    import_sheets(spark, [later], store)
    assert versions(spark, returns_path(store)) == [1, 2]
    together = str(tmp_path / "together")
    assert import_sheets(spark, [sheet, later], together).count() == 0
    assert long(read_snapshot(spark, returns_path(together)), "tax_year", "db_col") == long(read_snapshot(spark, returns_path(store)), "tax_year", "db_col")
    stored = long(read_snapshot(spark, returns_path(store)), "tax_year", "db_col")
    assert stored[(2024, "f_1040_24")] == 60.0 and (2024, "f_d_7") not in stored and len(stored) == 7
    wide = all_returns(spark, store, ["f_1040_24", "f_d_7"]).collect()
    assert [(r.tax_year, r.f_1040_24, r.f_d_7) for r in wide] == [(2021, 20000.0, None), (2022, -500.0, 0.0), (2024, 60.0, None)]
    table = {r.tax_year: r for r in analyze(spark, [sheet], store).collect()}
    assert table[2021].effective_tax_rate_pct == 20.0 and table[2021].yoy_f_1040_24_pct is None
    assert table[2022].yoy_f_1040_15_pct == pytest.approx(10.0)
    assert table[2024].yoy_f_1040_24_pct == pytest.approx(112.0)


def test_reports(spark, tmp_path):
    rows = scan_sheets(spark, [write(tmp_path, "s.csv", SHEET)]).rows
    returns = S.unpivot_sheet(rows)
    yoy = S.yoy_change(returns)
    grid = {r.label: (r["2021"], r["2022"], r["2024"]) for r in S.analysis_report(yoy, S.sheet_fields(rows), [2021, 2022, 2024]).collect()}
    assert grid["[1040:24] Total tax"] == (None, pytest.approx(-102.5), pytest.approx(6100.0))
    metrics = {r.metric: r["2021"] for r in S.ratio_report(returns, [2021]).collect()}
    assert metrics["Effective tax rate"] == 20.0


def test_sheets_of_orders_have_the_years_and_priorities_of_the_orders(spark):
    from recordloom.queries.sheet import sheet_of

    rows = [(1, "1-URGENT", "O", "1980-01-01", 50000.0), (1, "9-OTHER", "X", "2030-01-01", 60000.0)]
    orders = spark.createDataFrame(rows, "o_custkey long, o_orderpriority string, o_orderstatus string, o_orderdate string, o_totalprice double")
    found = S.unpivot_sheet(S.sheet_rows(sheet_of(orders), ["filer"]), ["filer"]).filter("value is not null").collect()
    assert sorted((r.tax_year, r.db_col, r.value) for r in found) == [(1980, "f_1040_15", 50000.0), (2030, "f_9_other_x", 60000.0)]


def test_import_of_no_sheet(spark, tmp_path):
    assert import_sheets(spark, [], str(tmp_path / "store")).isEmpty()


def test_wide_views_group_once(spark):
    """One aggregation per wide view: an entry per row in a task, not one per figure."""
    from recordloom.operators import sheet as S

    long = spark.createDataFrame([("a", 2001, "x", 1.0), ("a", 2001, "x", 3.0), ("a", 2001, "z", None), ("b", 2002, "y", 2.0), (None, None, None, 5.0)], "filer string, tax_year int, db_col string, value double")
    fields = spark.createDataFrame([("a", "x", "d", "1", "2"), ("b", "y", "e", "1", "3")], "filer string, db_col string, description string, form string, line string")
    yoy = long.withColumnRenamed("value", "yoy_pct")
    views = [
        (S.pivot_returns(long, ["x", "y"], ["filer"]), [("a", 2001, 3.0, None), ("b", 2002, None, 2.0), (None, None, None, None)], ["x", "y"]),
        (S.pivot_yoy(yoy, ["x", "y"], ["filer"]), [("a", 2001, 3.0, None), ("b", 2002, None, 2.0), (None, None, None, None)], ["yoy_x_pct", "yoy_y_pct"]),
        (S.analysis_report(yoy, fields, [2001, 2002], ["filer"]), [("a", "x", "[1:2] d", 3.0, None), ("b", "y", "[1:3] e", None, 2.0)], ["2001", "2002"]),
    ]
    for view, rows, names in views:
        assert view.columns[-2:] == names
        assert sorted(map(tuple, view.collect()), key=str) == sorted(rows, key=str)
        assert view._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
