"""Children of the root against a parser that holds the whole file, over small splits and chunks."""

import random
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from recordloom.plans.health_extract import extract, extract_report, write_documents, write_extract
from recordloom.sources.health_xml import roots, scan_elements
from recordloom.sources.xml_nesting import PLAIN, attributes, owner_mark, read_children, schemas_of, step


def text_of(rng, size):
    """An export with quoted marks, comments, CDATA, instructions, nested kinds and elements of every length."""
    names = ["Record", "Workout", "Audiogram", "Correlation", "Note"]

    def value():
        return rng.choice(["a", "x > y", "it's", "--", "]]", "/", "?", "&lt;Workout&gt;", "2024-01-01 10:00:00", "é\n z", ""])

    def element(depth):
        name = rng.choice(names)
        own = "".join(f"\n {k}={q}{value().replace(q, '')}{q}" for k in "abc"[: rng.randrange(4)] for q in [rng.choice("\"'")])
        if depth > 4 or rng.random() < 0.5:
            return f"<{name}{own}{rng.choice(['', ' '])}/>"
        inside = "".join(rng.choice([lambda: element(depth + 1), filler])() for _ in range(rng.randrange(5)))
        return f"<{name}{own}>{inside}</{name}>"

    def filler():
        return rng.choice(["\n", "a > b ", "<!-- <Record> > -- -->".replace("-- --", "- --"), "<!-- x -->", "<![CDATA[<Workout a='1'/> > ]]>", "<?pi a > b?>", "text/ > "])

    body = "".join(rng.choice([lambda: element(1), filler, lambda: "\n"])() for _ in range(size)).replace("<![CDATA[", "<![CDATA[")
    # Text and CDATA may stand below the root as well.
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<!DOCTYPE HealthData [\n<!-- a > b -->\n<!ELEMENT HealthData (Me,Record*)>\n]>\n<HealthData\n locale="x > y">{body}</HealthData>\n<!-- end > -->\n'


def children(text):
    root = ET.fromstring(text)
    return [(e.tag, dict(e.attrib), [dict(i.attrib) for i in e.iter("Workout") if i is not e], canonical(e)) for e in root]


def canonical(element):
    element.tail = None
    return ET.canonicalize(ET.tostring(element, encoding="unicode"))


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("chunk", [1, 60, 1 << 20])
def test_children_are_those_of_a_whole_parser(spark, tmp_path, chunk, small_splits):
    rng = random.Random(chunk)
    texts = {f"f{i}.xml": text_of(rng, size) for i, size in enumerate([0, 1, 5, 90, 200, 200])}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    read = read_children(spark, str(tmp_path / "*.xml"), "Workout", chunk)
    assert read.filter("top").select("block").distinct().count() > 3
    rows = sorted(read.collect(), key=lambda r: (r.file, r.block, r.nth, r.at))
    for name, text in texts.items():
        own = [r for r in rows if r.file.endswith(name)]
        assert [(r.kind, r.attributes) for r in own if not r.top] == [("HealthData", {"locale": "x > y"})]
        got = [(r.kind, r.attributes, [dict(i) for i in r.inner], canonical(ET.fromstring(r.xml))) for r in own if r.top]
        assert got == children(text)


@pytest.mark.parametrize("seed", range(30))
def test_steps_end_plain(seed):
    state, depth = PLAIN, 0
    pieces = text_of(random.Random(seed), 40).split(">")
    for piece in pieces[:-1]:
        state, change = step(state, piece)
        depth += change
        assert depth >= 0
    assert (state, depth) == (PLAIN, 0)


def test_attributes_read_references_once():
    assert attributes("<a b='&amp;lt; &#65;&#x42;&copy;' c=\"1\n2\" d = ''>") == {"b": "&lt; AB&copy;", "c": "1 2", "d": ""}


RUN = '<Workout startDate="2024-01-01 10:00:00" endDate="2024-01-01 11:00:00"/>'
AT = 'startDate="2024-01-01 10:05:00" endDate="2024-01-01 10:06:00"'


def test_only_children_of_a_health_root_are_kept(spark, tmp_path):
    """Inside elements of any kind, read or not, records stay out; workouts there still make windows."""
    texts = {
        "a": f'<HealthData><Audiogram><Record type="in" {AT}/>{RUN}</Audiogram><Record type="out" {AT}/></HealthData>',
        "b": f'<Other><Record type="other" {AT}/>{RUN}</Other>',
        "c": f'<Wrap><HealthData><Record type="deep" {AT}/>{RUN}</HealthData></Wrap>',
        "d": f'<h:HealthData xmlns:h="u"><h:Record type="spaced" {AT}><h:MetadataEntry key="k" value="1"/></h:Record>{RUN.replace("<", "<h:")}</h:HealthData>',
        "e": f"<HealthData>{RUN}<Record type='late' startDate='2025' endDate='2026'/><Record {AT}/><ActivitySummary day='1'/><Me/></HealthData>",
    }
    for name, text in texts.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "export.xml").write_text(text)
    paths = [str(tmp_path / name) for name in texts]
    kept, windows = extract(spark, paths, include_activity_summaries=True)
    assert sorted((r.subject.split("/")[-2], r._type) for r in kept["Record"].collect() if r._type) == [("a", "out"), ("d", "spaced")]
    assert kept["Record"].count() == 3 and kept["ActivitySummary"].first()._day == "1"
    assert sorted(r.subject.split("/")[-2] for r in windows.collect()) == ["a", "d", "e"]
    assert kept["Workout"].count() == 2
    report = {r.kind: r.n for r in extract_report(spark, paths).collect()}
    assert report == {"dated workouts": 3, "merged windows": 3, "Workout": 2, "Record": 3, "Correlation": 0, "ActivitySummary": 0, "written": 5}
    out = str(tmp_path / "out")
    assert {r.kind: r.n for r in write_extract(spark, paths, out, chunks_per_file=1).collect()} == {"Workout": 2, "Record": 3}
    back = scan_elements(spark, f"{out}/Record", "Record").collect()
    assert sorted(r._type or "" for r in back) == ["", "out", "spaced"]


def test_documents_have_all_kinds_in_the_order_of_the_export(spark, tmp_path, small_splits):
    records = "\n".join(f'<Record type="t{i}" {AT} note="a &gt; {i}"><MetadataEntry key="k" value="{i}"/></Record>{RUN if i % 9 == 0 else ""}' for i in range(40))
    for name in "ab":
        (tmp_path / name).mkdir()
        (tmp_path / name / "export.xml").write_text(f'<HealthData locale="{name}"><Me sex="x"/>\n{records}</HealthData>')
    paths = [str(tmp_path / n / "export.xml") for n in "ab"]
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("two", "two owners")
    report = {r.kind: r.n for r in write_documents(spark, paths, str(tmp_path / "out")).collect()}
    spark.sparkContext.setJobGroup("one", "one owner")
    write_documents(spark, paths[:1], str(tmp_path / "alone")).collect()
    assert abs(len(jobs.getJobIdsForGroup("two")) - len(jobs.getJobIdsForGroup("one"))) <= 3  # jobs do not grow with owners
    assert report["written"] == 2 * (40 + 5)
    files = sorted((tmp_path / "out" / "documents").glob("subject=*/piece=0/*.txt"))
    assert len(files) == 2
    for file in files:
        root = ET.parse(file).getroot()
        source = ET.fromstring((tmp_path / root.get("locale") / "export.xml").read_text())
        assert [canonical(e) for e in root] == [canonical(e) for e in source]


def test_schema_of_kinds(spark, tmp_path):
    (tmp_path / "x.xml").write_text('<HealthData><Record a="1"><M k="v"/><M/><N>t</N><P q="1">text</P></Record><Record b=""/><Me/></HealthData>')
    found = schemas_of(read_children(spark, str(tmp_path / "x.xml")), ["Record", "Me", "Workout"])
    assert found["Record"].simpleString() == "struct<M:array<struct<_k:string>>,N:string,P:struct<_VALUE:string,_q:string>,_a:string,_b:string>"
    assert set(found) == {"Record", "Me"}


@pytest.mark.parametrize("chunk", [1, 60, 1 << 20])
def test_documents_of_many_owners_in_one_file(spark, tmp_path, chunk, small_splits):
    """Children as of single documents, over small splits; a document that is cut off loses only what is open."""
    rng = random.Random(chunk)
    owners = {f"o {i}/\"<é>": text_of(rng, size) for i, size in enumerate([0, 1, 5, 90, 0, 200, 3])}
    cut = '<HealthData><Record a="1"/><Record b="2"><Note>'
    names = [r[0] for r in spark.createDataFrame([(o,) for o in owners], "o string").select(owner_mark(F.col("o"))).collect()]
    (tmp_path / "bundle=0").mkdir()
    marked = "".join(f"{mark}\n{text}" for mark, text in zip(names, owners.values()))
    (tmp_path / "bundle=0" / "part-0").write_text(f'<?recordloom owner="cut"?>{cut}{marked}')
    rows = sorted(read_children(spark, str(tmp_path), "Workout", chunk).collect(), key=lambda r: (r.block, r.nth, r.at))
    assert [(r.kind, r.attributes) for r in rows if r.subject == "cut"] == [("HealthData", {}), ("Record", {"a": "1"})]
    for name, text in owners.items():
        own = [r for r in rows if r.subject == name]
        assert [(r.kind, r.attributes) for r in own if not r.top] == [("HealthData", {"locale": "x > y"})]
        got = [(r.kind, r.attributes, [dict(i) for i in r.inner], canonical(ET.fromstring(r.xml))) for r in own if r.top]
        assert got == children(text)


def test_many_owners_share_files(spark, tmp_path):
    """With more owners than folders the extract and the documents are read back as from folders."""
    inside = f'<Record type="t" {AT}><M k="1"/><M k="2"/></Record>{RUN}<Correlation {AT}><Record type="in"/></Correlation>'
    for name in "abc":
        (tmp_path / name).mkdir()
        (tmp_path / name / "export.xml").write_text(f'<HealthData locale="{name}">{inside}</HealthData>')
    paths = [str(tmp_path / n / "export.xml") for n in "abc"]
    found = {}
    for folders in (1, 1000):
        for write, kind in ((write_extract, "Record"), (write_documents, "documents")):
            out = str(tmp_path / f"{kind}{folders}")
            counts = {r.kind: r.n for r in write(spark, paths, out, folders=folders).collect()}
            assert len(list((tmp_path / f"{kind}{folders}" / kind).glob("bundle=*"))) == (folders < 3)
            back = scan_elements(spark, f"{out}/{kind}", "Record")
            rows = sorted(back.select("subject", "_type", "_startDate", F.to_json("M").alias("m")).collect(), key=str)
            heads = sorted(roots(spark, f"{out}/{kind}").collect())
            assert found.setdefault(kind, (counts, rows, heads)) == (counts, rows, heads)
    assert len(found["Record"][1]) == 3 and len(found["documents"][1]) == 6


def test_exports_of_all_users_are_few_files(spark):
    """Files do not grow with users."""
    from recordloom.queries import files

    users = spark.read.parquet("/root/testdata/sf0.01/events.parquet").select("user_id").distinct().count()
    for written in (files._exports, files._nested_exports):
        assert len(spark.read.text(written(spark, "/root/testdata/sf0.01")).inputFiles()) <= 8 < users
