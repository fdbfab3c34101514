"""Parquet tables: appended to, or replaced by writing a new version, whole or of the buckets that change.

A table in buckets has a list beside it, ``buckets/v=<n>``, of the version that holds each bucket. A new
version holds the changed buckets only and is listed when it is complete, so the files of other buckets
stay as they are, readers keep what they began with, and a job that broke off changed nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.operators.merge import merge_replace
from recordloom.operators.shared import saved

#: Buckets of a table whose rows are replaced by owner, and of one that is only added to.
REPLACED_BUCKETS = 256
APPENDED_BUCKETS = 64


def _fs(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete versions; one whose job did not finish lacks the success mark."""
    fs, root = _fs(spark, path)
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    numbers = [int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit()]
    return sorted(n for n in numbers if fs.exists(_fs(spark, f"{path}/v={n:06d}/_SUCCESS")[1]))


def read_snapshot(spark: SparkSession, path: str) -> DataFrame | None:
    """The latest complete version, or None when nothing is stored."""
    held = bucket_versions(spark, path)
    if held is not None:
        return _read_buckets(spark, path, held)
    done = versions(spark, path)
    return spark.read.parquet(f"{path}/v={done[-1]:06d}") if done else None


def write_snapshot(table: DataFrame, path: str) -> str:
    """Writes the next version beside the one that may be being read; returns its path."""
    done = versions(table.sparkSession, path)
    target = f"{path}/v={(done[-1] if done else 0) + 1:06d}"
    table.write.mode("overwrite").parquet(target)
    return target


def bucket_versions(spark: SparkSession, path: str) -> dict[int, int] | None:
    """The version that holds each bucket; None where the table is not in buckets."""
    done = versions(spark, f"{path}/buckets")
    if not done:
        return None
    return {r.bucket: r.held for r in spark.read.parquet(f"{path}/buckets/v={done[-1]:06d}").collect()}


def _read_buckets(spark: SparkSession, path: str, held: dict[int, int]) -> DataFrame:
    folders = [f"{path}/v={version:06d}/bucket={bucket}" for bucket, version in sorted(held.items()) if version]
    return spark.read.option("basePath", path).parquet(*folders).drop("v", "bucket")


def replace_in_buckets(
    new: DataFrame, path: str, row: Sequence[str], by: Sequence[str], buckets: int = REPLACED_BUCKETS
) -> list[int]:
    """Replaces whole rows (see ``merge_replace``) by owner; reads and writes only the buckets of owners in ``new``.

    Returns the buckets written. The number of buckets is that of the first write. A table stored whole
    before is taken into buckets with the first replacement.
    """
    spark = new.sparkSession
    held = bucket_versions(spark, path)
    before = None if held is not None else read_snapshot(spark, path)
    n = len(held) if held is not None else buckets

    def with_bucket(df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64(*by), F.lit(n)).cast("int") if by else F.lit(0))

    new = saved(with_bucket(new))
    changed = sorted(r.bucket for r in new.select("bucket").distinct().collect())
    if held is not None:
        old = {b: v for b, v in held.items() if v and b in set(changed)}
        stored = with_bucket(_read_buckets(spark, path, old)) if old else None
    else:
        held = dict.fromkeys(range(n), 0)
        stored = None if before is None else with_bucket(before)
        if stored is not None:
            changed = sorted({*changed, *(r.bucket for r in stored.select("bucket").distinct().collect())})
    version = max([0, *versions(spark, path), *held.values()]) + 1
    result = merge_replace(stored, new, ["bucket", *row], by)
    result.repartition("bucket", *by).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/v={version:06d}")
    held |= dict.fromkeys(changed, version)
    listed = spark.createDataFrame(sorted(held.items()), "bucket int, held int").coalesce(1)
    listed.write.mode("overwrite").parquet(f"{path}/buckets/v={version:06d}")
    return changed


class Keyed:
    """A table that rows are added to by key, kept in Spark's buckets of ``row_key``.

    A join on ``row_key`` shuffles the rows that come in, never those that are stored.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = APPENDED_BUCKETS):
        self._spark, self._path = spark, path
        fs, marks = _fs(spark, f"{path}_buckets/*")
        found = [s.getPath().getName() for s in (fs.globStatus(marks) or [])]
        self._n = int(found[0]) if found else buckets
        self._new = not found
        fs, files = _fs(spark, f"{path}/*.parquet")
        self.exists = len(fs.globStatus(files) or []) > 0
        #: Files from before there were buckets are added to as they are.
        self._plain = self.exists and self._new
        digest = hashlib.sha1(f"{spark.sparkContext.applicationId}/{path}".encode()).hexdigest()
        self._name = f"keyed_{digest[:24]}"

    def read(self) -> DataFrame | None:
        if not self.exists:
            return None
        if self._plain:
            return self._spark.read.parquet(self._path)
        self._register()
        return self._spark.table(self._name)

    @property
    def has_keys(self) -> bool:
        return not self._plain

    def _register(self) -> None:
        if self._spark.catalog.tableExists(self._name):
            self._spark.catalog.refreshTable(self._name)
            return
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self._spark.read.parquet(self._path).schema)
        where = self._path.replace("'", "\\'")
        self._spark.sql(
            f"create table {self._name} ({columns}) using parquet clustered by (row_key) into {self._n} buckets location '{where}'"
        )

    def append(self, rows: DataFrame) -> None:
        """Adds rows; they have the column ``row_key`` unless the table is from before there were buckets."""
        if self._plain:
            rows.write.mode("append").parquet(self._path)
            return
        rows = rows.repartition(self._n, "row_key")
        if self.exists:
            self._register()
            rows.select(*self._spark.table(self._name).columns).write.insertInto(self._name)
        else:
            fs, mark = _fs(self._spark, f"{self._path}_buckets/{self._n}")
            fs.mkdirs(mark)
            writer = rows.write.bucketBy(self._n, "row_key").option("path", self._path).mode("overwrite")
            self._spark.sql(f"drop table if exists {self._name}")
            writer.saveAsTable(self._name)
            self.exists = True


def mark(spark: SparkSession, path: str) -> None:
    """Leaves a mark, an empty folder."""
    fs, folder = _fs(spark, path)
    fs.mkdirs(folder)


def marked(spark: SparkSession, path: str) -> bool:
    fs, folder = _fs(spark, path)
    return bool(fs.exists(folder))


def unmark(spark: SparkSession, path: str) -> None:
    fs, folder = _fs(spark, path)
    fs.delete(folder, True)


def read_appended(spark: SparkSession, path: str) -> DataFrame | None:
    """A table that is only appended to, or None when it does not exist."""
    fs, files = _fs(spark, f"{path}/*.parquet")
    return spark.read.parquet(path) if len(fs.globStatus(files) or []) else None


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)
