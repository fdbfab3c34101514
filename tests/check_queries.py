"""Compares every query with its SQL: ``python tests/check_queries.py [folder] [names...]``."""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def normal(value):
    if isinstance(value, float):
        return 0.0 if value == 0 else value
    return value


def compare(spark, con, name, query, sql, folder):
    """Problems found; none when rows, columns and values are the same."""
    df = query(spark, folder)
    got = df.collect()
    if sql is None:
        return [] if got else ["no rows"]
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    problems = []
    if sorted(columns) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} against {sorted(columns)}"]
    order = sorted(columns)
    ours = sorted((tuple(normal(r[c]) for c in order) for r in got), key=repr)
    at = [columns.index(c) for c in order]
    theirs = sorted((tuple(normal(r[i]) for i in at) for r in cursor.fetchall()), key=repr)
    if len(ours) != len(theirs):
        problems.append(f"{len(ours)} rows against {len(theirs)}")
    if ours != theirs:
        for a, b in zip(ours, theirs):
            if a != b:
                problems.append(f"{order}: {a} against {b}")
                break
    if {type(v) for r in ours for v in r} != {type(v) for r in theirs for v in r}:
        problems.append("types differ")
    return problems


def main():
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = database(folder), 0
    for name in names:
        start = time.time()
        try:
            problems = compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), folder)
        except Exception as error:  # noqa: BLE001
            problems = [f"{type(error).__name__}: {str(error)[:600]}"]
        bad += bool(problems)
        print(f"{name:28s} {time.time() - start:6.1f}s {'; '.join(problems) or 'same'}", flush=True)
    print("all the same" if not bad else f"{bad} differ")


if __name__ == "__main__":
    main()
