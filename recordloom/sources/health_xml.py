"""Elements of a health export: one table per element kind, attribute ``x`` as column ``_x``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from recordloom.sources.xml_nesting import children_of_kind, elements_inside, read_children, schemas_of


def _subject(df: DataFrame):
    """The owner of an element: the folder name ``subject=...`` of files written per owner, else the path of the file."""
    return F.col("subject") if "subject" in df.columns else F.col("_metadata.file_path")


def _bundled(spark: SparkSession, path: str | Sequence[str]) -> bool:
    """Whether files of many owners each, which lie in a folder ``bundle=<name>``, are among the input."""
    for name in [path] if isinstance(path, str) else path:
        own, inside = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (name, f"{name}/bundle=*"))
        files = own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if files.globStatus(inside) or any("/bundle=" in status.getPath().toString() for status in files.globStatus(own) or []):
            return True
    return False


def owner_attributes(children: DataFrame) -> DataFrame:
    """``(subject, attributes)``: the attribute text of the ``HealthData`` root of each owner, of what ``read_children`` gives."""
    own = children.filter((~F.col("top")) & (F.col("kind") == "HealthData"))
    text = F.regexp_extract("xml", r"(?s)^<[^\s/>]+(.*?)/?>$", 1)
    text = F.trim(F.regexp_replace(text, r"[\r\n\t]+", " "))
    return own.groupBy("subject").agg(F.min(text).alias("attributes"))


def roots(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``(subject, attributes)``: attribute text of each file's ``HealthData`` root, which may run over several lines."""
    if _bundled(spark, path):
        return owner_attributes(read_children(spark, path))
    pattern = r"(?s)<(?:\w+:)?HealthData(\s[^<]*)?$"
    tags = spark.read.option("lineSep", ">").text(path if isinstance(path, str) else list(path))
    tags = tags.filter(F.col("value").rlike(pattern))
    text = F.regexp_replace(F.regexp_extract("value", pattern, 1), r"[\r\n\t]+", " ")
    found = tags.select(_subject(tags).alias("subject"), F.trim(text).alias("attributes"))
    return found.groupBy("subject").agg(F.min("attributes").alias("attributes"))


def root_attributes(spark: SparkSession, path: str | Sequence[str]) -> str:
    """Attribute text of the ``HealthData`` root element of the first subject; without such a root an error."""
    found = roots(spark, path).orderBy("subject").first()
    if found is None:
        raise ValueError("no HealthData root element in the input")
    return found.attributes


def scan_elements(
    spark: SparkSession, path: str | Sequence[str], kind: str, schema: StructType | str | None = None
) -> DataFrame:
    """All elements of one kind, nested ones included, with ``subject`` = path of the file: exports of
    several people often have one name. Files written per owner have the owner's folder as ``subject``,
    documents in bundles the owner they are marked with.

    Values stay text. Without a schema the names are collected in a first pass over the files, so
    give one for large inputs.
    """
    if _bundled(spark, path):
        found = elements_inside(read_children(spark, path), kind)
        if schema is None:
            schema = schemas_of(found, [kind]).get(kind, StructType([]))
        elif not isinstance(schema, StructType):
            schema = StructType.fromDDL(schema)
        return children_of_kind(found, kind, schema)
    reader = (
        spark.read.format("xml")
        .option("rowTag", kind)
        .option("ignoreNamespace", True)
        .option("inferSchema", False)
        .option("nullValue", "\u0000")  # an empty attribute is an empty text, not NULL
    )
    if schema is not None:
        reader = reader.schema(schema)
    elements = reader.load(path if isinstance(path, str) else list(path))
    partitions = ("subject", "piece") if "subject" in elements.columns else ("subject",)
    others = [f"`{c}`" for c in elements.columns if c not in partitions]
    return elements.select(_subject(elements).alias("subject"), *others)


def subject_folder(subject):
    """Folder name of an owner: paths are too long for one, so their SHA-1."""
    return F.sha1(F.coalesce(subject, F.lit("")))


def write_elements(elements: DataFrame, path: str, kind: str, attributes: str = "", mode: str = "errorifexists") -> None:
    """Writes elements of one kind, one folder ``subject=<SHA-1>`` per owner, files below a ``HealthData`` root."""
    (
        elements.withColumn("subject", subject_folder(F.col("subject")))
        .write.format("xml")
        .option("rootTag", f"HealthData {attributes}".strip())
        .option("rowTag", kind)
        .option("declaration", 'version="1.0" encoding="UTF-8"')
        .partitionBy("subject")
        .mode(mode)
        .save(path)
    )
