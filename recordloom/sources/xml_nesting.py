"""Children of the root of XML files, found by matching brackets in one reading of the files.

A file is read as pieces that end at ``>``, in splits, so large files are read by many tasks. What stands
in a piece depends on where the piece begins: in plain text, or inside a quoted value, a comment, a CDATA
section or an instruction that holds a ``>``. A task does not know that for the start of its split, so it
keeps the answer for each case and the number of levels gone down or up; the splits of a file are then put
together in order, a few figures each. With the depth known everywhere, the elements below the root are
cut out of the text where they stand; only those that lie across a cut are put together in a shuffle.

A file may hold the documents of many owners, one after the other, so that files are as many as the size
asks for and not as there are owners: the instruction that ``owner_mark`` forms begins a document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import repeat
from urllib.parse import unquote_plus

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructField, StructType

from recordloom.operators.shared import saved

#: Characters of text that one row of the saved text holds, about.
CHUNK = 1 << 20

PLAIN, COMMENT, CDATA, INSTRUCTION, DOUBLE, SINGLE = range(6)
_ENDS = {COMMENT: "--", CDATA: "]]", INSTRUCTION: "?"}
_LAST = ("-", "]", "?")
_MARKS = {DOUBLE: '"', SINGLE: "'"}
_NAME = re.compile(r"</?(?:[^\s/:<>]*:)?([^\s/:<>]+)")
_ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")
_HIDDEN = re.compile(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>", re.DOTALL)
_PREFIX = re.compile(r"<(/?)[^\s/:<>!?]+:(?=[^\s/:<>])")
_TAG = re.compile(r"<(/?)([^\s/<>!?]+)([^\"'<>]*(?:(?:\"[^\"]*\"|'[^']*')[^\"'<>]*)*)>")
_VALUES = re.compile(r"\"[^\"]*\"|'[^']*'")
_REFERENCE = re.compile(r"&(#[0-9]+|#x[0-9A-Fa-f]+|lt|gt|amp|quot|apos);")
_NAMED = {"lt": "<", "gt": ">", "amp": "&", "quot": '"', "apos": "'"}
_OWNER = re.compile(r"<\?recordloom owner=\"([^\"<>]*)\"\?$")
#: Shapes of elements that a task remembers, so that their names are worked out once.
SHAPES = 1 << 14


def owner_mark(subject: Column) -> Column:
    """The instruction that begins the document of an owner in a file that holds many."""
    return F.concat(F.lit('<?recordloom owner="'), F.url_encode(subject), F.lit('"?>'))


def _owner(state: int, piece: str) -> str | None:
    """The owner whose document begins with a piece."""
    found = _OWNER.search(piece) if state == PLAIN and piece.endswith('"?') else None
    return unquote_plus(found[1]) if found else None


def _tag_rest(text: str) -> int:
    """The state after the rest of a tag: PLAIN when it is complete, else the quote that is open."""
    if text.count('"') % 2 == 0 and "'" not in text:
        return PLAIN
    left = _VALUES.sub("", text)
    at, mark = min(((left.find(m), s) for s, m in _MARKS.items() if m in left), default=(-1, PLAIN))
    return mark if at >= 0 else PLAIN


def step(state: int, piece: str) -> tuple[int, int]:
    """The state after a piece, and the levels it goes down (1), up (-1) or neither."""
    if state == PLAIN:
        at = piece.find("<")
        if at < 0:
            return PLAIN, 0
        kind = piece[at + 1 : at + 2]
        if kind == "/":
            return PLAIN, -1
        if kind not in ("!", "?"):
            after = _tag_rest(piece[at:])
            return after, int(after == PLAIN and piece[-1] != "/")
        if piece.startswith("<!--", at):
            return (PLAIN if piece.endswith("--") and len(piece) - at >= 6 else COMMENT), 0
        if piece.startswith("<![CDATA[", at):
            return (PLAIN if piece.endswith("]]") else CDATA), 0
        if piece.startswith("<!", at):
            return (COMMENT if "<!--" in piece and not piece.endswith("--") else PLAIN), 0
        return (PLAIN if piece.endswith("?") else INSTRUCTION), 0
    if state in _ENDS:
        return (PLAIN if piece.endswith(_ENDS[state]) else state), 0
    if state == DOUBLE and "'" not in piece and piece.count('"') % 2 == 0:
        return state, 0
    at = piece.find(_MARKS[state])
    if at < 0:
        return state, 0
    after = _tag_rest(piece[at + 1 :])
    return after, int(after == PLAIN and not piece.endswith("/"))


def _chunks(limit: int):
    """Rows of text in order; each with the state, depth and owner at its start for each state at the start of its split.

    With an owner that begins in the split the depth is that in the document, else it is relative to the split's start.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nth, held, size = None, 0, [], 0
        states, depths, owners, begin = list(range(6)), [0] * 6, [None] * 6, None
        rows: list[tuple] = []

        def close(last: bool) -> None:
            nonlocal nth, held, size, begin
            if held:
                rows.append((*key, nth, "".join(held), *begin))
                nth, held, size = nth + 1, [], 0
            if last and key is not None:
                rows.append((*key, nth, None, list(states), list(depths), list(owners)))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
            types = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()))
            names = ["subject", "file", "block", "nth", "text", "states", "depths", "owners"]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)
            rows.clear()
            return batch

        for batch in batches:
            place = [batch.column(c) for c in ("subject", "file", "block")]
            if all(len(c.unique()) == 1 for c in place):  # as most batches are
                keys = repeat(tuple(c[0].as_py() for c in place), batch.num_rows)
            else:
                keys = zip(*(c.to_pylist() for c in place), strict=True)
            for now, piece in zip(keys, batch.column("value").to_pylist(), strict=True):
                if now is not key and now != key:
                    close(True)
                    key, nth, held, size = now, 0, [], 0
                    block = now[2]
                    states, depths, owners = list(range(6)) if block else [PLAIN] * 6, [0] * 6, [None] * 6
                if not held:
                    begin = (list(states), list(depths), list(owners))
                held.append(piece + ">")
                size += len(piece) + 1
                owner = _owner(PLAIN, piece)
                # Without an end of a hidden part and with whole quotes only what is plain text moves on.
                if piece[-1:] not in _LAST and "'" not in piece and piece.count('"') % 2 == 0:
                    moving = [i for i in range(6) if states[i] == PLAIN]
                else:
                    moving = range(6)
                # States that have met go on together; the first of them is worked out.
                moved: dict[int, tuple[int, int]] = {}
                for i in moving:
                    state = states[i]
                    if state not in moved:
                        moved[state] = step(state, piece)
                    states[i], change = moved[state]
                    depths[i] += change
                    if owner is not None and state == PLAIN:
                        depths[i], owners[i] = 0, owner
                if size >= limit:
                    close(False)
            if sum(len(r[4] or "") for r in rows) >= limit:
                yield flush()
        close(True)
        yield flush()

    return work


def _entries(blocks: pd.DataFrame) -> pd.DataFrame:
    """State, depth and owner at the start of each split of one file."""
    blocks = blocks.sort_values("block")
    state, depth, owner, out = PLAIN, 0, None, []
    for states, depths, owners in zip(blocks["states"], blocks["depths"], blocks["owners"], strict=True):
        out.append((state, depth, owner))
        depth = int(depths[state]) + (depth if owners[state] is None else 0)
        state, owner = int(states[state]), owner if owners[state] is None else owners[state]
    out = pd.DataFrame(out, columns=["state", "depth", "owner"])
    return pd.DataFrame({"file": blocks["file"].to_numpy(), "block": blocks["block"].to_numpy(), **out})


@dataclass
class _Cutter:
    """Goes over the pieces of a chunk and cuts out the children of the root and the tag of the root."""

    state: int
    depth: int
    owner: str | None

    def cut(self, text: str) -> Iterator[tuple[str | None, bool, bool, bool, str]]:
        """(owner, below a root, begins here, ends here, text) of each child of a root or part of one, and of the root's own tag."""
        top = self.depth > 0
        held: list[str] | None = [] if self.depth > 1 or (self.depth <= 1 and self.state in _MARKS) else None
        begins = False
        pieces = text.split(">")
        pieces.pop()  # what follows the last mark: each piece was stored with its own
        for piece in pieces:
            before, state = self.depth, self.state
            self.state, change = step(state, piece)
            self.depth += change
            owner = _owner(state, piece)
            if owner is not None:  # what is still open is lost with the document before
                self.owner, self.depth, top, held, begins = owner, 0, False, None, False
                continue
            if held is None:
                at = piece.find("<")
                if state == PLAIN and before <= 1 and at >= 0 and piece[at + 1 : at + 2] not in ("!", "?", "/"):
                    held, begins = [piece[at:], ">"], True
            else:
                held += [piece, ">"]
            if held is None or self.state in _MARKS:
                continue
            # The tag of the root is complete one level down, a child of it when the depth is that of the root again.
            tag_done = change == 1 or state in _MARKS or (state == PLAIN and piece.endswith("/"))
            if before == 0 and tag_done or before >= 1 and self.depth <= 1 and (tag_done or change == -1):
                yield self.owner, top, begins, True, "".join(held)
                top, held, begins = True, None, False
        if held is not None:
            yield self.owner, top, begins, False, "".join(held)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["subject", "file", "block", "nth", "at", "top", "begins", "ends", "text"]
    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.string()]
    for batch in batches:
        for row in batch.to_pylist():
            cutter, out = _Cutter(row["state"], row["depth"], row["owner"]), []
            for at, (owner, top, begins, ends, text) in enumerate(cutter.cut(row["text"])):
                subject = row["subject"] if owner is None else owner
                out.append((subject, row["file"], row["block"], row["nth"], at, top, begins, ends, text))
            columns = list(zip(*out, strict=True)) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def _character(reference: re.Match) -> str:
    name = reference[1]
    if name[0] != "#":
        return _NAMED[name]
    return chr(int(name[2:], 16) if name[1] == "x" else int(name[1:]))


def attributes(tag: str) -> dict[str, str]:
    """The attributes of a start tag: white space as blanks, character references read."""
    found = _ATTRIBUTE.findall(tag)
    return {name: _REFERENCE.sub(_character, re.sub(r"\r\n|[\t\r\n]", " ", a or b)) for name, a, b in found}


def _escaped(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def _facts(xml: str) -> set[tuple[str, str]]:
    """What a schema needs: (path of an element, what it has): an attribute, a text, or more than one in its parent."""
    facts: set[tuple[str, str]] = set()
    path: list[str] = []
    seen: list[set[str]] = [set()]
    end = 0
    for tag in _TAG.finditer(xml):
        closing, name, inside = tag.groups()
        if path and xml[end : tag.start()].strip():
            facts.add(("/".join(path), "text"))
        end = tag.end()
        if closing:
            path.pop()
            seen.pop()
            continue
        here = "/".join([*path, name])
        facts.add((here, "one" if name not in seen[-1] else "many"))
        seen[-1].add(name)
        facts.update((here, f"_{attribute}") for attribute, _, _ in _ATTRIBUTE.findall(inside))
        if not inside.endswith("/"):
            path.append(name)
            seen.append(set())
    return facts


def _read(inner: str):
    """Per child of a root: kind, own attributes, text without prefixes, attributes of ``inner`` elements below it, facts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = pa.map_(pa.string(), pa.string())
        known: set[tuple[str, str]] = set()
        shapes: set[str] = set()
        for batch in batches:
            kinds, own, texts, below, facts = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                text = _HIDDEN.sub(lambda m: _escaped(m[0][9:-3]) if m[0].startswith("<![") else "", text)
                text = _PREFIX.sub(r"<\1", text)
                tags = _TAG.match(text)
                kinds.append(_NAME.match(text)[1])
                own.append(list(attributes(tags[0]).items()) if tags else [])
                texts.append(text)
                inside = [m for m in _TAG.finditer(text, tags.end() if tags else 0) if m[2] == inner and not m[1]] if f"<{inner}" in text[1:] else []
                below.append([list(attributes(m[0]).items()) for m in inside])
                shape, new = _VALUES.sub("", text), set()
                if shape not in shapes:
                    new = _facts(text) - known
                    known |= new
                    if len(shapes) >= SHAPES:
                        shapes.clear()
                    shapes.add(shape)
                facts.append([{"path": p, "fact": f} for p, f in sorted(new)])
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in ("subject", "file", "block", "nth", "at", "top")],
                    pa.array(kinds, pa.string()),
                    pa.array(own, words),
                    pa.array(texts, pa.string()),
                    pa.array(below, pa.list_(words)),
                    pa.array(facts, pa.list_(pa.struct([("path", pa.string()), ("fact", pa.string())]))),
                ],
                names=["subject", "file", "block", "nth", "at", "top", "kind", "attributes", "xml", "inner", "facts"],
            )

    return work


def read_children(spark: SparkSession, path: str | Sequence[str], inner: str = "Workout", chunk: int = CHUNK) -> DataFrame:
    """``(subject, file, block, nth, at, top, kind, attributes, xml, inner, facts)``, saved.

    One row per child of the root of each document (``top``), whatever stands inside it, and one for the root
    itself (not ``top``, its own tag only). A file is one document, or many with an ``owner_mark`` each, whose
    subject is that owner. ``(block, nth, at)`` is the order in the file. ``inner`` holds the
    attributes of the elements of that name anywhere inside a child. Prefixes of names are taken off and
    comments left out. A file that is cut off in the middle of an element loses that element.
    """
    reader = spark.read.option("lineSep", ">")
    pieces = reader.text(path if isinstance(path, str) else list(path))
    subject = F.col("subject").cast("string") if "subject" in pieces.columns else F.col("_metadata.file_path")
    pieces = pieces.select(
        subject.alias("subject"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        "value",
    )
    schema = "subject string, file string, block long, nth long, text string, states array<int>, depths array<int>, owners array<string>"
    chunks = saved(pieces.mapInArrow(_chunks(chunk), schema))
    blocks = chunks.filter("text is null").select("file", "block", "states", "depths", "owners")
    entries = saved(blocks.groupBy("file").applyInPandas(_entries, "file string, block long, state int, depth int, owner string"))
    own = F.col("owners")[F.col("state")]
    entered = chunks.filter("text is not null").join(entries, ["file", "block"]).select(
        "subject",
        "file",
        "block",
        "nth",
        "text",
        F.col("states")[F.col("state")].alias("state"),
        (F.when(own.isNull(), F.col("depth")).otherwise(0) + F.col("depths")[F.col("state")]).alias("depth"),
        F.coalesce(own, "owner").alias("owner"),
    )
    schema = "subject string, file string, block long, nth long, at long, top boolean, begins boolean, ends boolean, text string"
    parts = saved(entered.mapInArrow(_parts, schema))
    # What lies across a cut: few parts, the running number of beginnings tells them apart.
    order = Window.partitionBy("file").orderBy("block", "nth", "at").rowsBetween(Window.unboundedPreceding, 0)
    across = parts.filter("not (begins and ends)").withColumn("of", F.count_if("begins").over(order))
    place = F.struct("block", "nth", "at")
    joined = across.groupBy("file", "of").agg(
        F.min("subject").alias("subject"),
        F.min_by(F.struct("block", "nth", "at", "top"), place).alias("first"),
        F.bool_or("ends").alias("ends"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "nth", "at", "text"))), lambda p: p["text"]), "").alias("text"),
    )
    columns = ["subject", "file", "block", "nth", "at", "top", "text"]
    joined = joined.filter("ends and of > 0").select("subject", "file", "first.*", "text").select(*columns)
    whole = parts.filter("begins and ends").select(*columns).unionByName(joined)
    schema = (
        "subject string, file string, block long, nth long, at long, top boolean, kind string, attributes map<string,string>, "
        "xml string, inner array<map<string,string>>, facts array<struct<path: string, fact: string>>"
    )
    return saved(whole.mapInArrow(_read(inner), schema))


def elements_inside(children: DataFrame, kind: str) -> DataFrame:
    """Elements of a kind among the children and anywhere inside them, saved: ``(subject, top, kind, xml, facts)``.

    Of elements of the kind inside each other the outermost counts. ``facts`` are those of the element itself.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[tuple[str, str]] = set()
        shapes: set[str] = set()
        for batch in batches:
            subjects, texts, facts = [], [], []
            for subject, child in zip(batch.column("subject").to_pylist(), batch.column("xml").to_pylist(), strict=True):
                begin, depth = 0, 0
                for tag in _TAG.finditer(child) if f"<{kind}" in child else ():
                    closing, name, inside = tag.groups()
                    if name != kind:
                        continue
                    begin = begin if depth else tag.start()
                    depth += -1 if closing else int(not inside.endswith("/"))
                    if depth:
                        continue
                    text = child[begin : tag.end()]
                    shape, new = _VALUES.sub("", text), set()
                    if shape not in shapes:
                        new = _facts(text) - known
                        known |= new
                        if len(shapes) >= SHAPES:
                            shapes.clear()
                        shapes.add(shape)
                    subjects.append(subject)
                    texts.append(text)
                    facts.append([{"path": p, "fact": f} for p, f in sorted(new)])
            kinds = pa.array([kind] * len(texts), pa.string())
            found = pa.array(facts, pa.list_(pa.struct([("path", pa.string()), ("fact", pa.string())])))
            arrays = [pa.array(subjects, pa.string()), pa.array([True] * len(texts), pa.bool_()), kinds, pa.array(texts, pa.string()), found]
            yield pa.RecordBatch.from_arrays(arrays, names=["subject", "top", "kind", "xml", "facts"])

    schema = "subject string, top boolean, kind string, xml string, facts array<struct<path: string, fact: string>>"
    return saved(children.filter("top").select("subject", "xml").mapInArrow(work, schema))


def schemas_of(children: DataFrame, kinds: Sequence[str]) -> dict[str, StructType]:
    """The schema of each kind that occurs: attribute ``x`` as ``_x``, elements inside as structs, arrays where one has several.

    The driver gets the distinct names of a kind, not the elements.
    """
    found = children.filter(F.col("top") & F.col("kind").isin(list(kinds))).select(F.explode("facts").alias("f")).select("f.*").distinct()
    has: dict[tuple[str, ...], set[str]] = {}
    for row in found.collect():
        has.setdefault(tuple(row["path"].split("/")), set()).add(row["fact"])

    def type_of(path: tuple[str, ...]) -> DataType:
        fields = [StructField(f, StringType()) for f in has[path] if f.startswith("_")]
        for child in has:
            if child[:-1] == path:
                inside = type_of(child)
                fields.append(StructField(child[-1], ArrayType(inside) if "many" in has[child] else inside))
        if not fields:
            return StringType()
        if "text" in has[path]:
            fields.append(StructField("_VALUE", StringType()))
        return StructType(sorted(fields, key=lambda f: f.name))

    found = {kind: type_of((kind,)) for kind in kinds if (kind,) in has}
    return {kind: schema if isinstance(schema, StructType) else StructType([StructField("_VALUE", schema)]) for kind, schema in found.items()}


def children_of_kind(children: DataFrame, kind: str, schema: StructType) -> DataFrame:
    """The children of one kind with a column per attribute and inner element, as the XML source reads them."""
    options = {"ignoreNamespace": "true", "nullValue": "\u0000", "mode": "PERMISSIVE"}
    rows = children.filter(F.col("top") & (F.col("kind") == kind))
    return rows.select("subject", F.from_xml("xml", schema, options).alias("e")).select("subject", "e.*")
