"""Window operators over `events`: purchases are workouts, the other events are one-minute records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.operators.intervals import (
    element_counts,
    interval_overlap,
    keep_records,
    merge_intervals,
    top_level,
)
from recordloom.queries.tables import table

BY = ["subject"]


def _elements(spark: SparkSession, folder: str) -> DataFrame:
    minutes = F.when(F.col("event_type") == "purchase", F.floor("value") * 10).otherwise(1).cast("int")
    text = "yyyy-MM-dd HH:mm:ss"
    return table(spark, folder, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("subject"),
        F.col("event_type").alias("type"),
        F.date_format("ts", text).alias("start"),
        F.date_format(F.timestamp_add("MINUTE", minutes, F.col("ts")), text).alias("end"),
    )


def _windows(spark: SparkSession, folder: str) -> DataFrame:
    return merge_intervals(_elements(spark, folder).filter("type = 'purchase'"), BY)


def _records(spark: SparkSession, folder: str) -> DataFrame:
    return _elements(spark, folder).filter("type <> 'purchase'")


def overlap(spark: SparkSession, folder: str) -> DataFrame:
    return interval_overlap(_records(spark, folder), _windows(spark, folder), BY)


def overlap_forced(spark: SparkSession, folder: str) -> DataFrame:
    return keep_records(_records(spark, folder), _windows(spark, folder), BY, force_types=["signup"])


def counts(spark: SparkSession, folder: str) -> DataFrame:
    """Kept elements per kind and subject: workouts, overlapping records, merged windows."""
    workouts = _elements(spark, folder).filter("type = 'purchase'").select(*BY, F.lit("Workout").alias("kind"))
    records = overlap(spark, folder).select(*BY, F.lit("Record").alias("kind"))
    windows = _windows(spark, folder).select(*BY, F.lit("Window").alias("kind"))
    return element_counts(workouts.unionByName(records).unionByName(windows), BY)


def without_nested(spark: SparkSession, folder: str) -> DataFrame:
    """Events read as records, errors being nested ones too: those are taken off again."""
    elements = _elements(spark, folder).drop("id")
    # The parent has an attribute, source, that neither its child nor the other records have a value for.
    elements = elements.withColumn("source", F.lit(None).cast("string"))
    child = F.array(F.struct("type", "start", "end"))
    parents = elements.filter("type = 'error'").select("subject", F.lit("cuff").alias("source"), child.alias("Record"))
    return top_level(elements, parents, "Record", BY).drop("source")


QUERIES = {
    "merge_intervals": _windows,
    "interval_overlap": overlap,
    "interval_overlap_forced": overlap_forced,
    "element_counts": counts,
    "top_level_elements": without_nested,
}

_ELEMENTS = """elements as (
  select event_id as id, user_id as subject, event_type as type, strftime(ts, '%Y-%m-%d %H:%M:%S') as start,
    strftime(ts + to_minutes(case when event_type = 'purchase' then floor(value)::bigint * 10 else 1 end), '%Y-%m-%d %H:%M:%S') as "end"
  from events)"""
_MERGED = """reached as (
  select *, max("end") over (partition by subject order by start, "end" rows between unbounded preceding and 1 preceding) as before
  from elements where type = 'purchase'),
islands as (
  select *, sum(case when before is null or start > before then 1 else 0 end)
    over (partition by subject order by start, "end" rows unbounded preceding) as island from reached),
windows as (
  select subject, min(start) as start, max("end") as "end", 1::bigint as copies from islands group by subject, island)"""
_KEPT = """exists (select 1 from windows w where w.subject = e.subject and w.start <= e."end" and w."end" >= e.start)"""
_BASE = f"with {_ELEMENTS}, {_MERGED}"

SQL = {
    "merge_intervals": f'{_BASE} select subject, start, "end", copies from windows',
    "interval_overlap": f"{_BASE} select * from elements e where type <> 'purchase' and {_KEPT}",
    "interval_overlap_forced": f"{_BASE} select * from elements e where type <> 'purchase' and (type = 'signup' or {_KEPT})",
    "element_counts": f"""{_BASE}
select subject, 'Workout' as kind, count(*) as n from elements where type = 'purchase' group by 1
union all select subject, 'Record', count(*) from elements e where type <> 'purchase' and {_KEPT} group by 1
union all select subject, 'Window', count(*) from windows group by 1""",
    "top_level_elements": f"""with {_ELEMENTS}
select subject, type, start, "end" from elements except all select subject, type, start, "end" from elements where type = 'error'""",
}
