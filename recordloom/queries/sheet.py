"""Sheet operators over `orders`: each customer files one sheet of order sums, priority and status by year."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions import fixed_values as V
from recordloom.operators import sheet as S
from recordloom.operators.merge import merge_replace
from recordloom.operators.shared import saved
from recordloom.plans.sheet_import import field_list
from recordloom.queries.tables import table

BY = ["filer"]
# Order priority as form, status as line of the form; form 0 is a note and no data.
FORMS = {"1-URGENT": "1040", "2-HIGH": "D", "3-MEDIUM": "540", "4-NOT SPECIFIED": " A-1 ", "5-LOW": "0"}
LINES = {
    "1040": {"O": "15", "F": "24", "P": "33"},
    "D": {"O": "7", "F": "15", "P": "16"},
    "540": {"O": "19", "F": "64", "P": "78.b"},
    " A-1 ": {"O": "1z", "F": "1.z", "P": "8a"},
    "0": {"O": "0", "F": "1", "P": "2"},
}


def _form() -> F.Column:
    out = F.coalesce("o_orderpriority", F.lit(""))  # an unknown priority is a form of its own
    for priority, form in FORMS.items():
        out = F.when(F.col("o_orderpriority") == priority, form).otherwise(out)
    return out


def _line() -> F.Column:
    out = F.coalesce("o_orderstatus", F.lit(""))
    for form, lines in LINES.items():
        for status, line in lines.items():
            out = F.when((F.col("form") == form) & (F.col("o_orderstatus") == status), line).otherwise(out)
    return out


def _sums(orders: DataFrame) -> DataFrame:
    return (
        orders.select(
            F.col("o_custkey").alias("filer"),
            "o_orderpriority",
            "o_orderstatus",
            F.year("o_orderdate").alias("year"),
            F.floor("o_totalprice").alias("whole"),
        )
        .withColumn("form", _form())
        .withColumn("line", _line())
    )


def sheet_of(orders: DataFrame) -> DataFrame:
    """The sheets as wide text: dollars with commas, parentheses for status F, NA below 20,000.

    The years are those of the orders, a short list whatever the number of orders.
    """
    years = sorted(r.y for r in orders.select(F.year("o_orderdate").alias("y")).distinct().collect() if r.y is not None)
    wide = (
        _sums(orders)
        .groupBy("filer", F.col("form").alias("Form"), F.col("line").alias("Line"), "o_orderpriority", "o_orderstatus")
        .pivot("year", years)
        .agg(F.sum("whole"))
    )

    def text(year: int):
        grouped = F.format_number(F.col(f"`{year}`"), 0)
        dollars = F.concat(F.lit("$"), grouped)
        written = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("("), grouped, F.lit(")"))).otherwise(dollars)
        return F.when(F.col(f"`{year}`") < 20000, "NA").otherwise(written).alias(str(year))

    return wide.select(
        "filer",
        F.ascii("o_orderstatus").alias("ord"),
        "Form",
        "Line",
        F.concat("o_orderpriority", F.lit("/"), "o_orderstatus").alias("Description"),
        *[text(y) for y in years],
    )


def sheet(spark: SparkSession, folder: str) -> DataFrame:
    return sheet_of(table(spark, folder, "orders"))


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    return S.sheet_rows(sheet(spark, folder), BY)


def fields(spark: SparkSession, folder: str) -> DataFrame:
    return S.sheet_fields(_rows(spark, folder), BY)


def returns(spark: SparkSession, folder: str) -> DataFrame:
    return S.unpivot_sheet(_rows(spark, folder), BY)


def returns_with_gap(spark: SparkSession, folder: str) -> DataFrame:
    """Every third filer did not import 1998, so 1999 is compared with 1997."""
    return returns(spark, folder).filter("not (tax_year = 1998 and filer % 3 = 0)")


def field_names(spark: SparkSession, folder: str) -> list[str]:
    """Names of the fields of the sheets: one per priority and status of the orders, so few."""
    return field_list(_rows(spark, folder))


def pivot(spark: SparkSession, folder: str) -> DataFrame:
    return S.pivot_returns(returns(spark, folder), field_names(spark, folder), BY)


def yoy(spark: SparkSession, folder: str) -> DataFrame:
    return S.yoy_change(returns_with_gap(spark, folder), field_names(spark, folder), BY)


def wide_yoy(spark: SparkSession, folder: str) -> DataFrame:
    return S.pivot_yoy(S.yoy_change(returns_with_gap(spark, folder), None, BY), field_names(spark, folder), BY)


def ratios(spark: SparkSession, folder: str) -> DataFrame:
    return S.derived_ratios(returns(spark, folder), BY)


def analysis(spark: SparkSession, folder: str) -> DataFrame:
    return S.analysis_table(returns_with_gap(spark, folder), field_names(spark, folder), BY)


def replaced(spark: SparkSession, folder: str) -> DataFrame:
    """A later import of 1997 and after that lacks one field replaces those years whole."""
    stored = saved(returns(spark, folder))
    new = stored.filter("tax_year >= 1997 and db_col <> 'f_d_7'").withColumn("value", F.col("value") + 1)
    return merge_replace(stored, new, by=BY)


def report(spark: SparkSession, folder: str) -> DataFrame:
    """The grid has a column for every year that was filed."""
    stored = saved(returns_with_gap(spark, folder))
    years = sorted(r.tax_year for r in stored.select("tax_year").distinct().collect())
    grid = S.analysis_report(S.yoy_change(stored, None, BY), fields(spark, folder), years, BY)
    return grid.withColumnsRenamed({str(y): f"y{y}" for y in years})


QUERIES = {
    "sheet_fields": fields,
    "unpivot_sheet": returns,
    "pivot_returns": pivot,
    "yoy_change": yoy,
    "pivot_yoy": wide_yoy,
    "derived_ratios": ratios,
    "analysis_table": analysis,
    "merge_replace": replaced,
    "analysis_report": report,
}

# ---------------------------------------------------------------- SQL


def _sql_case(column: str, cases: dict) -> str:
    return f"case {column} " + " ".join(f"when '{k}' then '{v}'" for k, v in cases.items()) + " end"


_SQL_FORMS = {p: f.strip() for p, f in FORMS.items()}
_SQL_LINES = {f"{p}/{s}": line for p, f in FORMS.items() for s, line in LINES[f].items()}
# Lines O and F of the fourth form share a name; O comes later in the sheet, so O counts.
RETURNS = f"""forms as (
  select distinct o_custkey as filer, o_orderpriority || '/' || o_orderstatus as description, o_orderstatus as status,
    coalesce({_sql_case("o_orderpriority", _SQL_FORMS)}, trim(o_orderpriority)) as form,
    coalesce({_sql_case("o_orderpriority || '/' || o_orderstatus", _SQL_LINES)}, trim(o_orderstatus)) as line
  from orders),
lines as (
  select *, regexp_replace(replace(lower('f_' || form || '_' || line), '-', '_'), '[^a-z0-9_]', '', 'g') as db_col
  from forms where form <> '' and line <> '' and form <> '0'),
fields as (
  select * exclude (n) from (select *, row_number() over (partition by filer, db_col order by ascii(status) desc) as n from lines) where n = 1),
sums as (
  select o_custkey as filer, o_orderpriority || '/' || o_orderstatus as description, year(o_orderdate)::int as tax_year,
    sum(floor(o_totalprice)::bigint)::bigint as s
  from orders group by all),
returns as (
  select f.filer, y.tax_year, f.db_col, case when s.s < 20000 then null when f.status = 'F' then -s.s else s.s end::double as value
  from fields f cross join (select distinct year(o_orderdate)::int as tax_year from orders) y
  left join sums s on s.filer = f.filer and s.description = f.description and s.tax_year = y.tax_year)"""
_CHANGES = """years as (
  select filer, tax_year, lag(tax_year) over (partition by filer order by tax_year) as before
  from (select distinct filer, tax_year from gapped)),
changes as (
  select y.filer, y.tax_year, n.db_col,
    case when p.value <> 0 then (c.value - p.value) / abs(p.value) * 100 end as yoy_pct
  from years y cross join (select distinct db_col from fields) n
  left join gapped c on c.filer = y.filer and c.tax_year = y.tax_year and c.db_col = n.db_col
  left join gapped p on p.filer = y.filer and p.tax_year = y.before and p.db_col = n.db_col)"""
_GAP = f"""gapped as (select * from returns where not (tax_year = 1998 and filer % 3 = 0)),
{_CHANGES}"""
_WIDE_YOY = "(pivot changes on 'yoy_' || db_col || '_pct' using max(yoy_pct) group by filer, tax_year)"
_RATIOS = ", ".join(
    f"""max(case when db_col = '{top}' then value end) / nullif(max(case when db_col = '{bottom}' then value end), 0) * 100 as {name}"""
    for name, top, bottom, _ in V.RATIOS
)



def changes_sql(tables: str, returns: str) -> str:
    """The analysis of a table of returns."""
    return f"""{tables}, gapped as (select * from {returns}), {_CHANGES},
r as (select filer, tax_year, {_RATIOS} from gapped group by filer, tax_year)
select * from r join {_WIDE_YOY} w using (filer, tax_year)"""


SQL = {
    "sheet_fields": f"with {RETURNS} select filer, db_col, description, form, line from fields",
    "unpivot_sheet": f"with {RETURNS} select filer, tax_year, db_col, value from returns",
    "pivot_returns": f"""with {RETURNS}
select * from (pivot returns on db_col using max(value) group by filer, tax_year)""",
    "yoy_change": f"with {RETURNS}, {_GAP} select filer, tax_year, db_col, yoy_pct from changes",
    "pivot_yoy": f"with {RETURNS}, {_GAP} select * from {_WIDE_YOY}",
    "derived_ratios": f"with {RETURNS} select filer, tax_year, {_RATIOS} from returns group by filer, tax_year",
    "analysis_table": f"""with {RETURNS}, {_GAP},
r as (select filer, tax_year, {_RATIOS} from gapped group by filer, tax_year)
select * from r join {_WIDE_YOY} w using (filer, tax_year)""",
    "merge_replace": f"""with {RETURNS},
fresh as (select filer, tax_year, db_col, value + 1 as value from returns where tax_year >= 1997 and db_col <> 'f_d_7')
select * from fresh union all select * from returns r
where not exists (select 1 from fresh n where n.filer = r.filer and n.tax_year = r.tax_year)""",
    "analysis_report": f"""with {RETURNS}, {_GAP},
labelled as (
  select c.filer, c.db_col, '[' || f.form || ':' || f.line || '] ' || f.description as label, c.tax_year, c.yoy_pct
  from changes c join fields f on f.filer = c.filer and f.db_col = c.db_col)
select * from (pivot labelled on 'y' || tax_year using max(yoy_pct) group by filer, db_col, label)""",
}
