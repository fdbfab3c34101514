"""CSV files whose headers differ, read by position with the input order kept.

One `spark.read.csv` over files of several headers would use one header for all of them, so the first
line of every file is looked up, and files are read together per distinct header.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Files of more bytes are not read whole for their first line.
WHOLE_BYTES = 1 << 22
# Jobs for first lines that run at once.
HEADER_JOBS = 16
# File positions are broadcast up to this many files (a few hundred bytes each).
BROADCAST_FILES = 200_000

_ROW_BITS = 33  # the row number inside a partition, as monotonically_increasing_id gives it
_BYTE_BITS = 43  # byte position inside a file, where one file is read in several pieces


@dataclass(frozen=True)
class InputFile:
    pos: int  # position in the request
    path: str
    uri: str | None  # as `_metadata.file_path` gives it; None: missing
    location: str | None = None  # as Spark's readers take it
    owner: str | None = None
    header: str | None = None

    @property
    def name(self) -> str:
        return self.path.rstrip("/").rsplit("/", 1)[-1]


def _same_form(uri: Column) -> Column:
    return F.regexp_replace(uri, "^file:/+", "file:/")


def _locations(files: Sequence[InputFile]) -> list[str]:
    return sorted({f.location for f in files if f.location})


def find_files(
    spark: SparkSession, paths: Sequence[str], owner_of: Callable[[str], str] | None = None
) -> list[InputFile]:
    """The requested files with their first lines; only file names and header lines reach the driver."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found, large = [], set()
    for pos, path in enumerate(paths):
        hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
        fs = hadoop_path.getFileSystem(conf)
        full = fs.makeQualified(hadoop_path) if fs.exists(hadoop_path) else None
        uri = re.sub("^file:/+", "file:/", full.toUri().toString()) if full else None
        if full and fs.getFileStatus(full).getLen() > WHOLE_BYTES:
            large.add(full.toString())
        owner = owner_of(path) if owner_of else None
        found.append(InputFile(pos, path, uri, full.toString() if full else None, owner))
    headers = {}
    small = [p for p in _locations(found) if p not in large]
    for lines in (_first_lines(spark, small), _first_lines_of_large(spark, sorted(large))):
        headers |= {uri: line.lstrip("\ufeff").strip() for uri, line in lines}
    return [replace(f, header=headers.get(f.uri, "")) for f in found]


def _first_lines(spark: SparkSession, locations: Sequence[str]) -> list[tuple[str, str]]:
    if not locations:
        return []
    lines = spark.read.text(list(locations)).select(
        _same_form(F.col("_metadata.file_path")).alias("uri"),
        F.col("value"),
        F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at"),
    )
    return [(r.uri, r.header) for r in lines.groupBy("uri").agg(F.min_by("value", "at").alias("header")).collect()]


def _first_lines_of_large(spark: SparkSession, locations: Sequence[str]) -> list[tuple[str, str]]:
    """First lines of files that are not to be read whole: a job each, which takes the first row of the first split.

    Spark stops reading there, after one buffer, whatever the size of the file. Jobs run side by side.
    """

    def first(location: str) -> tuple[str, str]:
        row = spark.read.text(location).select(_same_form(F.col("_metadata.file_path")).alias("uri"), "value").head()
        return row.uri, row.value

    with ThreadPoolExecutor(HEADER_JOBS) as pool:
        return list(pool.map(first, locations))


def sheet_of_row(order: Column, multi_line: bool = True) -> Column:
    """The position in the request of the file that a row with this ``ord`` is of."""
    return F.shiftright(order, _ROW_BITS if multi_line else _BYTE_BITS)


def header_names(header: str) -> list[str]:
    return next(csv.reader([header]), [])


def read_cells(spark: SparkSession, files: Sequence[InputFile], multi_line: bool = True) -> DataFrame:
    """Rows of files that share one header: ``ord, source_file, owner, c0, c1, ...``, all cells text.

    ``ord`` puts the rows into request order. With ``multi_line`` (line breaks inside quotes are
    possible) a file is read in one piece; without, large files are read in several.
    """
    width = max(1, len(header_names(files[0].header)))
    schema = ", ".join(f"c{i} string" for i in range(width))
    reader = (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", multi_line)
        .option("escape", '"')
        .option("enforceSchema", True)
    )
    cells = [f"c{i}" for i in range(width)]
    row = F.monotonically_increasing_id().bitwiseAND(F.lit(2**_ROW_BITS - 1))
    rows = reader.csv(_locations(files)).select(
        _same_form(F.col("_metadata.file_path")).alias("_uri"),
        F.col("_metadata.file_block_start").alias("_start"),
        row.alias("_row"),
        *cells,
    )
    places = spark.createDataFrame(
        [(f.uri, f.pos, f.name, f.owner) for f in files], "_uri string, _pos long, source_file string, owner string"
    )
    if len(files) <= BROADCAST_FILES:
        places = F.broadcast(places)
    # A piece of a file that is not its last one fills its partition alone, and a row takes at least
    # two bytes, so start + row number rises through the pieces of a file.
    bits = _ROW_BITS if multi_line else _BYTE_BITS
    order = F.shiftleft(F.col("_pos"), bits) + F.col("_start") + F.col("_row")
    return rows.join(places, "_uri").select(order.alias("ord"), "source_file", "owner", *cells)
