"""Ledger operators over `orders`, `events`, `customer` and `part`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions import fixed_values as V
from recordloom.functions.numbers import parse_amount, parse_dollar, parse_value
from recordloom.functions.text import field_name, first_filled, normalize_date, normalize_description
from recordloom.operators.merge import first_rows, import_counts, merge_ignore
from recordloom.operators.summary import annual_by_description, annual_by_source, annual_summary, annual_total
from recordloom.operators.transfers import cancel_transfers
from recordloom.queries.tables import table
from recordloom.sources.ledger_files import detect_layout

# ---------------------------------------------------------------- inputs


def orders_as_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as transactions of two accounts in whole thousands, one source file per status."""
    orders = table(spark, folder, "orders")
    description = F.concat("o_orderpriority", F.lit("-"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0"))
    sign = F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(-1.0)
    return orders.select(
        F.col("o_orderkey").alias("ord"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
        description.alias("description"),
        normalize_description(description).alias("normalized_description"),
        (sign * F.round(F.col("o_totalprice") / 100000) * 1000).alias("amount"),
        F.lit("transaction").alias("category"),
        (F.col("o_custkey") % 2).cast("string").alias("account_id"),
        F.col("o_orderstatus").alias("source_file"),
    )


def _sql_normalize(text: str) -> str:
    out = f"trim({text})"
    for pattern, replacement in V.DESCRIPTION_RULES:
        out = f"regexp_replace({out}, '{pattern}', '{replacement}', 'g')"
    runs = f"regexp_extract_all(trim({out}), '([A-Za-z]+|[^A-Za-z]+)')"
    return f"array_to_string(list_transform({runs}, lambda x: upper(x[1]) || lower(x[2:])), '')"


_ORDERS = f"""ledger as (
  select o_orderkey as ord, strftime(o_orderdate, '%Y-%m-%d') as date,
    o_orderpriority || '-' || lpad(o_orderkey::varchar, 8, '0') as description,
    {_sql_normalize("o_orderpriority || '-' || lpad(o_orderkey::varchar, 8, '0')")} as normalized_description,
    (case when o_orderstatus = 'F' then 1 else -1 end) * round(o_totalprice / 100000) * 1000 as amount,
    (o_custkey % 2)::varchar as account_id, o_orderstatus as source_file
  from orders)"""

_FIGURES = """
    sum(case when amount > 0 then amount::decimal(18,2) else 0 end)::double as total_income,
    sum(case when amount < 0 then amount::decimal(18,2) else 0 end)::double as total_spend,
    sum(amount::decimal(18,2))::double as net, count(*) as txn_count"""


def events_as_ledger(spark: SparkSession, folder: str, accounts: int) -> DataFrame:
    """Events as transactions in whole units: purchases and errors go out, the others come in."""
    events = table(spark, folder, "events")
    sign = F.when(F.col("event_type").isin("purchase", "error"), -1.0).otherwise(1.0)
    return events.select(
        F.col("event_id").alias("ord"),
        F.date_format("ts", "yyyy-MM-dd").alias("date"),
        F.col("event_type").alias("description"),
        (sign * F.floor("value")).cast("double").alias("amount"),
        (F.col("user_id") % accounts).cast("string").alias("account_id"),
        (F.hour("ts") < 12).alias("morning"),
    )


def _sql_events(accounts: int) -> str:
    return f"""ledger as (
  select event_id as ord, strftime(ts, '%Y-%m-%d') as date, event_type as description,
    (case when event_type in ('purchase', 'error') then -1.0 else 1.0 end * floor(value))::double as amount,
    (user_id % {accounts})::varchar as account_id, extract(hour from ts) < 12 as morning
  from events)"""


_KEPT = ["ord", "date", "amount", "account_id"]

# Two accounts: the n-th positive of one account meets the n-th negative of the other.
_SQL_CANCELLED_OF_TWO = """numbered as (
  select *, abs(amount) as cents, sign(amount) as side,
    row_number() over (partition by date, abs(amount), sign(amount), account_id order by ord) as n
  from ledger where amount <> 0),
gone as (
  select unnest([p.ord, q.ord]) as ord from numbered p join numbered q
    on p.date = q.date and p.cents = q.cents and p.n = q.n and p.account_id <> q.account_id
  where p.side > 0 and q.side < 0)"""

# Any number of accounts: the rule row by row, one positive of every bucket per step.
_SQL_CANCELLED_OF_MANY = """sides as (
  select date, abs(amount) as cents, account_id, ord, sign(amount) as side,
    row_number() over (partition by date, abs(amount), sign(amount) order by ord) as n
  from ledger where amount <> 0),
negatives as (
  select date, cents, list(struct_pack(ord := ord, account := account_id) order by n) as free
  from sides where side < 0 group by date, cents),
steps as (
  select date, cents, 0::bigint as n, free, null::bigint as positive, null::bigint as negative from negatives
  union all
  select s.date, s.cents, s.n + 1,
    list_filter(s.free, lambda f: f.ord is distinct from list_filter(s.free, lambda g: g.account <> p.account_id)[1].ord),
    case when len(list_filter(s.free, lambda g: g.account <> p.account_id)) > 0 then p.ord end,
    list_filter(s.free, lambda g: g.account <> p.account_id)[1].ord
  from steps s join sides p on p.side > 0 and p.date = s.date and p.cents = s.cents and p.n = s.n + 1),
gone as (
  select positive as ord from steps where positive is not null
  union all select negative from steps where negative is not null)"""

# ---------------------------------------------------------------- queries


def ledger_summary(spark: SparkSession, folder: str) -> DataFrame:
    """The whole ledger run: clean, cancel transfers, leave out repeated rows, summarise."""
    kept = cancel_transfers(orders_as_ledger(spark, folder))
    return annual_summary(merge_ignore(kept, None))


def summary_of(operator):
    return lambda spark, folder: operator(orders_as_ledger(spark, folder))


def cancel(accounts: int):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        ledger = events_as_ledger(spark, folder, accounts)
        return cancel_transfers(ledger).select(*_KEPT)

    return query


def events_in_one_bucket(spark: SparkSession, folder: str) -> DataFrame:
    """All events on one day with one amount, four sixths of the users on the first of three accounts."""
    events = table(spark, folder, "events")
    return events.select(
        F.col("event_id").alias("ord"),
        F.lit("2000-01-01").alias("date"),
        F.when(F.col("event_type").isin("purchase", "error"), -1.0).otherwise(1.0).alias("amount"),
        F.greatest(F.col("user_id") % 6 - 3, F.lit(0)).cast("long").alias("account_id"),
    )


def cancel_skewed(spark: SparkSession, folder: str) -> DataFrame:
    """One bucket of all rows, split into many small blocks and chunks."""
    return cancel_transfers(events_in_one_bucket(spark, folder), block=1024, chunk=256).select(*_KEPT)


# Three accounts in one bucket: the rule row by row, with one queue of negatives per account and the number
# used of each.
_SQL_CANCELLED_SKEWED = """ledger as (
  select event_id as ord, '2000-01-01' as date,
    case when event_type in ('purchase', 'error') then -1.0 else 1.0 end::double as amount,
    greatest(user_id % 6 - 3, 0)::bigint as account_id
  from events),
queues as (
  select list(ord order by ord) filter (amount < 0 and account_id = 0) as q0,
    list(ord order by ord) filter (amount < 0 and account_id = 1) as q1,
    list(ord order by ord) filter (amount < 0 and account_id = 2) as q2,
    list(ord order by ord) filter (amount > 0) as p,
    list(account_id order by ord) filter (amount > 0) as a
  from ledger),
steps as (
  select 0::bigint as n, 0::bigint as u0, 0::bigint as u1, 0::bigint as u2, null::bigint as positive, null::bigint as negative
  union all
  select n + 1, u0 + (h0 = least(h0, h1, h2) is true)::bigint, u1 + (h1 = least(h0, h1, h2) is true)::bigint,
    u2 + (h2 = least(h0, h1, h2) is true)::bigint, case when least(h0, h1, h2) is not null then o end, least(h0, h1, h2)
  from (
    select n, u0, u1, u2, p[n + 1] as o, case when a[n + 1] <> 0 then q0[u0 + 1] end as h0,
      case when a[n + 1] <> 1 then q1[u1 + 1] end as h1, case when a[n + 1] <> 2 then q2[u2 + 1] end as h2
    from steps, queues where n < len(p))),
gone as (
  select positive as ord from steps where positive is not null
  union all select negative from steps where negative is not null)"""


def _merged(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    batch = events_as_ledger(spark, folder, 2)
    stored = first_rows(batch.filter("morning"))
    return batch, merge_ignore(batch, stored)


def merge_events(spark: SparkSession, folder: str) -> DataFrame:
    """All events imported into a store that holds those of the mornings."""
    return _merged(spark, folder)[1].select(*_KEPT, "description")


def merge_event_counts(spark: SparkSession, folder: str) -> DataFrame:
    return import_counts(*_merged(spark, folder))


def import_report(spark: SparkSession, folder: str) -> DataFrame:
    """Parsed, kept and cancelled transactions per source file."""
    ledger = orders_as_ledger(spark, folder)
    parsed = ledger.groupBy("source_file").agg(F.count("*").alias("parsed"))
    kept = cancel_transfers(ledger).groupBy("source_file").agg(F.count("*").alias("kept"))
    left = F.coalesce("kept", F.lit(0))
    return parsed.join(kept, "source_file", "left").select(
        "source_file", "parsed", left.alias("kept"), (F.col("parsed") - left).alias("cancelled")
    )


def descriptions(spark: SparkSession, folder: str) -> DataFrame:
    """Customer and part names with the kinds of suffixes that statements carry."""
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    parts = table(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    named = customers.withColumn("kind", F.lit("c")).unionByName(parts.withColumn("kind", F.lit("p")))
    n = F.col("id") % 6
    raw = (
        F.when(n == 0, F.concat("name", F.lit("-00000000")))
        .when(n == 1, F.concat("name", F.lit(" (Account ****0000)")))
        .when(n == 2, F.concat(F.lit("XXXX12"), "name", F.lit(" -A0000 ")))
        .when(n == 3, F.concat(F.lit(" 7eleven o'neil--"), "name", F.lit("_inc")))
        .when(n == 4, F.concat("name", F.lit(" 1234-56-7")))
        .otherwise(F.col("name"))
    )
    return named.select("kind", "id", normalize_description(raw).alias("normalized_description"))


_SQL_RAW = """case id % 6 when 0 then name || '-00000000' when 1 then name || ' (Account ****0000)'
    when 2 then 'XXXX12' || name || ' -A0000 ' when 3 then ' 7eleven o''neil--' || name || '_inc'
    when 4 then name || ' 1234-56-7' else name end"""


def dates(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("o_orderkey") % 4
    raw = (
        F.when(n == 0, F.date_format("o_orderdate", "M/d/yyyy"))
        .when(n == 1, F.date_format("o_orderdate", "MM/dd/yyyy"))
        .when(n == 2, F.date_format("o_orderdate", "yyyy-MM-dd"))
        .otherwise(F.date_format("o_orderdate", "M/d"))
    )
    return table(spark, folder, "orders").select("o_orderkey", normalize_date(raw).alias("date"))


def amounts(spark: SparkSession, folder: str) -> DataFrame:
    """One figure written in several ways, read by the three parsers."""
    whole = F.floor("o_totalprice").cast("string")
    grouped = F.format_number(F.floor("o_totalprice"), 0)
    n = F.col("o_orderkey") % 8
    raw = (
        F.when(n == 0, F.concat(F.lit("$"), grouped, F.lit(".50")))
        .when(n == 1, F.concat(F.lit("("), grouped, F.lit(")")))
        .when(n == 2, F.concat(F.lit(" -"), grouped, F.lit(".25 ")))
        .when(n == 3, F.lit("N/A"))
        .when(n == 4, F.lit("-"))
        .when(n == 5, F.concat(whole, F.lit("d")))
        .when(n == 6, F.concat(whole, F.lit("_0")))
        .otherwise(whole)
    )
    return table(spark, folder, "orders").select(
        "o_orderkey",
        parse_amount(raw).alias("amount"),
        parse_dollar(raw).alias("dollar"),
        parse_value(raw).alias("value"),
        first_filled(F.when(n == 3, F.lit("")).otherwise(whole), F.when(n < 4, F.lit("second"))).alias("filled"),
    )


def field_names(spark: SparkSession, folder: str) -> DataFrame:
    name = field_name(F.col("p_brand"), F.concat("p_type", F.lit("-"), "p_size"))
    return table(spark, folder, "part").select("p_partkey", name.alias("db_col"))


def layouts(spark: SparkSession, folder: str) -> DataFrame:
    """Header lines of five kinds, classified."""
    a, b = "Transaction date,Description,Type,Amount", "Transaction Date,Transaction Description,Transaction Type,Debit,Credit,Balance"
    n = F.col("o_orderkey") % 5
    header = (
        F.when(n == 0, F.lit(a))
        .when(n == 1, F.lit(b))
        .when(n == 2, F.concat(F.upper(F.lit(a)), F.lit(", "), "o_orderpriority"))
        .when(n == 3, F.lit(b + ",Description,Type,Amount"))
        .otherwise(F.concat(F.lit("Transaction date,Description,Type,"), "o_orderpriority"))
    )
    return (
        table(spark, folder, "orders")
        .withColumn("layout", detect_layout(header))
        .groupBy("layout", "o_orderpriority")
        .agg(F.count("*").alias("n"))
    )


QUERIES = {
    "ledger_summary": ledger_summary,
    "annual_summary": summary_of(annual_summary),
    "annual_total": summary_of(annual_total),
    "annual_by_description": summary_of(annual_by_description),
    "annual_by_source": summary_of(annual_by_source),
    "cancel_transfers": cancel(2),
    "cancel_transfers_multi": cancel(3),
    "cancel_transfers_skewed": cancel_skewed,
    "merge_ignore": merge_events,
    "import_counts": merge_event_counts,
    "import_summary": import_report,
    "normalize_description": descriptions,
    "normalize_date": dates,
    "parse_figures": amounts,
    "field_name": field_names,
    "detect_layout": layouts,
}

_SETS = f"""select year,
    case grouping(normalized_description) + grouping(source_file)
      when 2 then 'total' else case when grouping(source_file) = 1 then 'description' else 'source_file' end end as group_type,
    case grouping(normalized_description) + grouping(source_file)
      when 2 then 'all' else coalesce(normalized_description, source_file) end as group_value, {_FIGURES}
  from (select *, substr(date, 1, 4) as year from {{rows}})
  group by grouping sets ((year), (year, normalized_description), (year, source_file))"""


def _sql_by(value: str) -> str:
    return f"with {_ORDERS} select substr(date, 1, 4) as year, {value} as group_value, {_FIGURES} from ledger group by 1, 2"


_SQL_MERGED = """firsts as (
  select * from (select *, row_number() over (partition by date, description, amount, account_id order by ord) as n from ledger) where n = 1),
fresh as (
  select * from firsts f where not exists (select 1 from ledger s where s.morning and s.date = f.date
    and s.description = f.description and s.amount = f.amount and s.account_id = f.account_id))"""

SQL = {
    "ledger_summary": f"""with {_ORDERS}, {_SQL_CANCELLED_OF_TWO},
stored as (
  select * from (select *, row_number() over (partition by date, description, amount, account_id order by ord) as n
    from ledger where ord not in (select ord from gone)) where n = 1)
{_SETS.format(rows="stored")}""",
    "annual_summary": f"with {_ORDERS} {_SETS.format(rows='ledger')}",
    "annual_total": _sql_by("'all'"),
    "annual_by_description": _sql_by("normalized_description"),
    "annual_by_source": _sql_by("source_file"),
    "cancel_transfers": f"""with {_sql_events(2)}, {_SQL_CANCELLED_OF_TWO}
select ord, date, amount, account_id from ledger where ord not in (select ord from gone)""",
    "cancel_transfers_multi": f"""with recursive {_sql_events(3)}, {_SQL_CANCELLED_OF_MANY}
select ord, date, amount, account_id from ledger where ord not in (select ord from gone)""",
    "cancel_transfers_skewed": f"""with recursive {_SQL_CANCELLED_SKEWED}
select ord, date, amount, account_id from ledger where ord not in (select ord from gone)""",
    "merge_ignore": f"with {_sql_events(2)}, {_SQL_MERGED} select ord, date, amount, account_id, description from fresh",
    "import_counts": f"""with {_sql_events(2)}, {_SQL_MERGED}
select count(*) as inserted, (select count(*) from ledger) - count(*) as skipped from fresh""",
    "import_summary": f"""with {_ORDERS}, {_SQL_CANCELLED_OF_TWO}
select source_file, count(*) as parsed, count(*) filter (ord not in (select ord from gone)) as kept,
  count(*) filter (ord in (select ord from gone)) as cancelled
from ledger group by source_file""",
    "normalize_description": f"""with named as (
  select 'c' as kind, c_custkey as id, c_name as name from customer
  union all select 'p', p_partkey, p_name from part)
select kind, id, {_sql_normalize(_SQL_RAW)} as normalized_description from named""",
    "normalize_date": """select o_orderkey, case when o_orderkey % 4 = 3
    then month(o_orderdate) || '/' || day(o_orderdate) else strftime(o_orderdate, '%Y-%m-%d') end as date from orders""",
    "parse_figures": """with w as (select o_orderkey, o_orderkey % 8 as n, floor(o_totalprice)::double as v from orders)
select o_orderkey,
  case n when 2 then -v - 0.25 when 6 then v * 10 when 7 then v else 0 end::double as amount,
  case n when 0 then v + 0.5 when 2 then -v - 0.25 when 6 then v * 10 when 7 then v else 0 end::double as dollar,
  case n when 0 then v + 0.5 when 1 then -v when 2 then -v - 0.25 when 6 then v * 10 when 7 then v end::double as value,
  case n when 3 then 'second' else v::bigint::varchar end as filled
from w""",
    "field_name": """select p_partkey, regexp_replace(replace(lower('f_' || p_brand || '_' || p_type || '-' || p_size), '-', '_'),
  '[^a-z0-9_]', '', 'g') as db_col from part""",
    "detect_layout": """select case o_orderkey % 5 when 0 then 'wealthfront' when 1 then 'discover' when 2 then 'wealthfront'
    when 3 then 'discover' end as layout, o_orderpriority, count(*) as n from orders group by 1, 2""",
}
