"""WARC archives: written with revisit records, read back by verified chains of record boundaries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordloom.operators.shared import new_folder, saved

#: Fixed values of the format.
MAGIC = "WARC/1.1\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
RECORDS_PER_FILE = 20_000
#: Bytes that the end of a header is looked for in first; where they hold none, the whole piece is searched.
HEADER_BYTES = 1 << 16


def base32(sha1_hex: Column) -> Column:
    """The 32 base32 digits of a SHA-1 given as 40 hex digits: five hex digits make four."""
    out = []
    for i in range(8):
        part = F.conv(F.substring(sha1_hex, 5 * i + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            out.append(F.substring(F.lit(BASE32), F.shiftright(part, shift).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*out)


def visible(text: Column) -> Column:
    """The text with the UTF-8 bytes of all but visible ASCII characters as %XX, so it is one line for any reader."""
    runs = F.regexp_extract_all(text, F.lit(r"[\x21-\x7E]+|[^\x21-\x7E]+"), F.lit(0))
    hidden = F.transform(
        runs,
        lambda run: F.when(run.rlike(r"^[\x21-\x7E]"), run).otherwise(F.regexp_replace(F.hex(F.encode(run, "UTF-8")), "(..)", r"%$1")),
    )
    return F.when(text.rlike(r"[^\x21-\x7E]"), F.array_join(hidden, "")).otherwise(text)


def _head(*fields: tuple[str, Column]) -> Column:
    lines = [F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")) for name, value in fields]
    return F.concat(F.lit(MAGIC), *lines, F.lit("\r\n"))


def plan_records(pages: DataFrame, id_col: str, url_col: str, payload_col: str, revisit_bytes: int) -> DataFrame:
    """The pages with payload, payload_bytes, sha1, and refers_to (null for responses)."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("sha1", F.sha1("payload"))
    rows = rows.withColumn("_same", F.sha2(F.encode("payload", "UTF-8"), 256))
    # Only hashes are grouped; copies shrink to one row per map task before the shuffle. Payloads stay where
    # they are unless the list of revisits is too long to be sent to them.
    keys = rows.select("_id", "_same", "payload_bytes")
    first = keys.groupBy("_same").agg(F.max("_id").alias("_first"))
    again = keys.join(first, "_same").filter((F.col("payload_bytes") >= revisit_bytes) & F.col("_first").isNotNull())
    again = again.filter(~F.col("_id").eqNullSafe(F.col("_first")))
    again = saved(again.select(F.col("_id").alias("_page"), F.col("_same").alias("_of"), F.col("_first").alias("refers_to")).distinct())
    on = F.col("_id").eqNullSafe(F.col("_page")) & (F.col("_same") == F.col("_of"))
    return rows.join(again, on, "left").drop("_same", "_of", "_page")


def write_archives(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    revisit_bytes: int = 0,
    records_per_file: int = RECORDS_PER_FILE,
) -> None:
    """Writes a response or revisit record per page into .warc text files in ``folder``.

    Of pages with equal payloads of at least ``revisit_bytes`` bytes the one with the largest id is the
    response; the others are revisits that name it. Null payloads are empty. In a group of null ids all
    are responses, as are rows that repeat the largest id. All but visible ASCII characters of a url are
    written as %XX; a null url is left out. Ids are encoded as in a query of a url.
    """
    rows = plan_records(pages, id_col, url_col, payload_col, revisit_bytes)
    name = F.coalesce(F.url_encode(F.col("_id").cast("string")), F.lit(""))
    common = [
        ("WARC-Record-ID", F.concat(F.lit("<urn:page:"), name, F.lit(">"))),
        ("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        ("WARC-Target-URI", F.coalesce(visible(F.col("url")), F.lit("about:blank"))),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha1")))),
        ("Content-Type", F.lit("application/http;msgtype=response")),
    ]
    length = len(_HTTP)
    response = F.concat(
        _head(("WARC-Type", F.lit("response")), *common, ("Content-Length", (F.col("payload_bytes") + length).cast("string"))),
        F.lit(_HTTP),
        F.col("payload"),
    )
    refers = F.concat(F.lit("<urn:page:"), F.url_encode(F.col("refers_to").cast("string")), F.lit(">"))
    revisit = F.concat(
        _head(
            ("WARC-Type", F.lit("revisit")),
            *common,
            ("WARC-Refers-To", refers),
            ("WARC-Profile", F.lit(PROFILE)),
            ("Content-Length", F.lit(str(length))),
        ),
        F.lit(_HTTP),
    )
    # A record ends with two line ends; the writer puts the second one.
    record = F.concat(F.when(F.col("refers_to").isNull(), response).otherwise(revisit), F.lit("\r\n"))
    writer = rows.select(record.alias("value")).write.option("lineSep", "\r\n").option("maxRecordsPerFile", records_per_file)
    writer.text(folder)


def _chain(table: pa.Table) -> pa.Table:
    """Marks the candidates of one file that a chain of records from its start reaches, by pointer jumping."""
    at = np.asarray(table.column("at"))
    order = np.argsort(at)
    at = at[order]
    to = np.asarray(table.column("next"))[order]
    n = len(at)
    # Node n is the end of all chains; a successor that is no candidate leads there.
    place = np.searchsorted(at, to)
    jump = np.append(np.where((place < n) & (at[np.minimum(place, n - 1)] == to), place, n), n)
    reached = np.zeros(n + 1, dtype=bool)
    reached[0] = at[0] == 0
    # After round r the marks hold all records within 2^r steps of the start.
    while True:
        more = reached.copy()
        more[jump[reached]] = True
        if (more == reached).all():
            break
        reached, jump = more, jump[jump]
    hit = np.flatnonzero(reached[:n])
    file = table.column("_file").take(pa.array(order[hit]))
    return pa.table({"_file": file, "_start": pa.array(at[hit]), "_next": pa.array(to[hit])})


def _after_blank_line(value: Column) -> Column:
    """The byte, from 1, at which the first empty line of the value begins; 0 if there is none."""
    near = F.instr(F.decode(F.substring(value, 1, HEADER_BYTES), "ISO-8859-1"), "\r\n\r\n")
    far = F.when(F.octet_length(value) > HEADER_BYTES, F.instr(F.decode(value, "ISO-8859-1"), "\r\n\r\n")).otherwise(near)
    return F.when(near > 0, near).otherwise(far)


def _field(header: Column, name: str) -> Column:
    # Lines end at \n only (d): Java would also begin one after U+0085 and others.
    return F.trim(F.regexp_extract(header, rf"(?imd)^{name}:([^\r\n]*)", 1))


def _described(block: Column) -> list[Column]:
    """Size and SHA-1 of the payload of a block: what follows its HTTP header."""
    payload = F.substring(block, _after_blank_line(block) + 4, F.octet_length(block))
    return [F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload).alias("sha1")]


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(file, start, header, payload_bytes, sha1): the records of uncompressed archives, read in splits.

    A file is cut at every occurrence of the magic, wherever it stands; lengths of pieces add up to
    offsets. Each piece that could start a record is a candidate with the offset of its successor, taken
    from its Content-Length. Per file, pointer jumping from offset 0 keeps the candidates that are
    reached, so a magic inside a payload is none: its piece belongs to the record it lies in. The chain
    needs 16 bytes per candidate, so the longest file bounds a task's memory, not the number of files.

    A record in one piece is described where it is read. Only records that are cut by a magic of their own
    have their pieces read again and joined. A file whose chain does not lead to its end, as one that does not
    start with the magic or holds a broken record, raises. An empty folder gives no rows.
    """
    text = spark.read.option("lineSep", MAGIC).schema("value string").text(folder)
    text = text.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_size").alias("file_size"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("line"),
        F.col("value").cast("binary").alias("value"),
    )
    cut = _after_blank_line(F.col("value"))
    head = F.when(cut > 0, F.decode(F.substring(F.col("value"), F.lit(1), cut - 1), "UTF-8"))
    long = F.regexp_extract("header", r"(?imd)^Content-Length:[ \t]*([0-9]{1,18})", 1)
    found = text.withColumn("cut", cut).withColumn("header", head).withColumn("size", F.octet_length("value") + len(MAGIC))
    found = found.withColumn("long", F.when(long != "", long).cast("long"))
    block = F.substring(F.col("value"), F.col("cut") + 4, F.col("long").cast("int"))
    found = found.withColumn("block", F.when((F.col("cut") > 0) & (F.col("size") - len(MAGIC) >= F.col("cut") + 3 + F.col("long")), block))
    narrow = saved(found.select("file", "file_size", "split", "line", "size", "cut", "long", "header", *_described(F.col("block"))))
    # Offsets: the pieces before it in the split, and the splits before that, each with the magic that ends it.
    inner = Window.partitionBy("file", "split").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = narrow.groupBy("file", "split").agg(F.sum("size").alias("_size"))
    splits = splits.select("file", "split", F.coalesce(F.sum("_size").over(outer), F.lit(0)).alias("before"))
    within = F.coalesce(F.sum("size").over(inner), F.lit(0))
    # A piece begins after its magic; the first one of a file is what stands before the first magic.
    pieces = narrow.select("file", "file_size", "split", "line", "size", "cut", "long", within.alias("within")).join(splits, ["file", "split"])
    pieces = pieces.withColumn("at", F.col("before") + F.col("within") - len(MAGIC))
    candidates = pieces.filter((F.col("at") >= 0) & (F.col("cut") > 0) & F.col("long").isNotNull())
    after = F.col("at") + len(MAGIC) + F.col("cut") + 3 + F.col("long") + 4
    candidates = candidates.select(F.col("file").alias("_file"), "at", after.alias("next"))
    starts = candidates.groupBy("_file").applyInArrow(_chain, "_file string, _start long, _next long")
    starts = saved(
        pieces.join(starts, (F.col("file") == F.col("_file")) & (F.col("at") == F.col("_start")), "left").select(
            "file", "file_size", "split", "line", "size", "at", F.col("_start").alias("start"), F.col("_next").alias("next")
        )
    )
    # The last record may lack the two line ends after it.
    ends = starts.groupBy("file").agg(F.max("file_size").alias("size"), F.coalesce(F.max("next"), F.lit(0)).alias("end"))
    lost = ends.filter((F.col("end") < F.col("size")) | (F.col("end") - 4 > F.col("size"))).first()
    if lost is not None:
        raise ValueError(f"records of {lost['file']} lead to byte {lost['end']} of {lost['size']}")
    whole = narrow.select("line", "header", "payload_bytes", "sha1").join(starts.filter("start is not null"), "line")
    out = whole.filter("sha1 is not null").select("file", "start", "header", "payload_bytes", "sha1")
    broken = saved(whole.filter("sha1 is null").select("file", F.col("start").alias("_from"), F.col("next").alias("_to")))
    if broken.isEmpty():
        return out
    # The pieces of these records: those that lie before the end of the last start at or before them.
    upto = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    of = starts.withColumn("_last", F.max("start").over(upto)).select("file", "split", "line", "size", "at", "_last")
    of = of.join(broken.withColumnRenamed("file", "_file"), (F.col("file") == F.col("_file")) & (F.col("_last") == F.col("_from")))
    of = of.filter(F.col("at") < F.col("_to"))
    # Read again by split, number and size; where Spark has split the files otherwise this time, pieces are missing.
    again = text.select("file", "split", "line", "value", (F.octet_length("value") + len(MAGIC)).alias("size"))
    parts = saved(of.drop("_file").join(again, ["file", "split", "line", "size"]))
    if parts.count() != of.count():
        raise RuntimeError("the archives were split otherwise when they were read again")
    parts = parts.groupBy("file", F.col("_from").alias("start")).agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("_parts"))
    joined = F.aggregate(
        F.slice("_parts", 2, F.size("_parts")),
        F.element_at("_parts", 1)["value"],
        lambda acc, x: F.concat(acc, F.lit(MAGIC.encode()), x["value"]),
    )
    rest = parts.select("file", "start", joined.alias("value")).withColumn("cut", _after_blank_line(F.col("value")))
    rest = rest.withColumn("header", F.decode(F.substring(F.col("value"), F.lit(1), F.col("cut") - 1), "UTF-8"))
    rest = rest.withColumn("block", F.substring(F.col("value"), F.col("cut") + 4, long.cast("int")))
    return out.unionByName(rest.select("file", "start", "header", *_described(F.col("block"))))


def page_records(spark: SparkSession, folder: str, id_type: str = "long") -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A revisit has size and digest of the response it names. Responses that share an id hold one payload.
    """
    header = F.col("header")

    def page(name: str) -> Column:
        # A page without id has an empty name.
        return F.try_url_decode(F.nullif(F.col(name), F.lit(""))).try_cast(id_type)

    found = read_archives(spark, folder).select(
        F.regexp_extract(_field(header, "WARC-Record-ID"), "<urn:page:(.*)>", 1).alias("_id"),
        F.regexp_extract(_field(header, "WARC-Refers-To"), "<urn:page:(.*)>", 1).alias("_to"),
        _field(header, "WARC-Type").alias("record_type"),
        "payload_bytes",
        "sha1",
    )
    found = saved(found)
    own = found.filter("record_type = 'response'").withColumn("_to", F.lit(None).cast("string"))
    held = own.groupBy("_id").agg(F.first("payload_bytes").alias("payload_bytes"), F.first("sha1").alias("sha1"))
    again = found.filter("record_type = 'revisit'").drop("payload_bytes", "sha1")
    again = again.join(held.withColumnRenamed("_id", "_to"), "_to", "left")
    out = own.unionByName(again)
    return out.select(
        page("_id").alias("page_id"),
        "payload_bytes",
        base32(F.col("sha1")).alias("payload_digest"),
        "record_type",
        page("_to").alias("refers_to"),
    )


def round_trip(pages: DataFrame, revisit_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes the pages to archives in the shared folder and reads them back: one row per page."""
    spark = pages.sparkSession
    folder = new_folder(spark, "archives")
    write_archives(pages, folder, id_col, url_col, payload_col, revisit_bytes)
    return page_records(spark, folder, pages.schema[id_col].dataType.simpleString())
