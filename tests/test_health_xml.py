import pytest

from recordloom.operators.intervals import element_counts
from recordloom.plans.health_extract import extract, kept_counts, write_extract
from recordloom.sources.health_xml import root_attributes, scan_elements

XML = """<?xml version="1.0" encoding="UTF-8"?>
<!DOCTYPE HealthData [
<!ELEMENT HealthData (ExportDate,Me,Record*)>
]>
<HealthData locale="en_US">
 <ExportDate value="2024-02-01"/>
 <Me sex="x"/>
 <Record type="HR" startDate="2024-01-01 10:00:00 -0800" endDate="2024-01-01 10:05:00 -0800" value="7 &lt; 8"/>
 <Record type="Steps" startDate="2024-01-01 12:00:00 -0800" endDate="2024-01-01 12:05:00 -0800" value="1"/>
 <Correlation type="BP" startDate="2024-01-01 10:01:00 -0800" endDate="2024-01-01 10:02:00 -0800">
  <Record type="Sys" startDate="2024-01-01 10:01:00 -0800" endDate="2024-01-01 10:02:00 -0800" value="3"/>
 </Correlation>
 <Correlation type="BP" startDate="2024-01-02 10:01:00 -0800" endDate="2024-01-02 10:02:00 -0800">
  <Record type="Sys" startDate="2024-01-02 10:01:00 -0800" endDate="2024-01-02 10:02:00 -0800" value="4"/>
 </Correlation>
 <Workout workoutActivityType="Run" startDate="2024-01-01 10:00:00 -0800" endDate="2024-01-01 11:00:00 -0800"/>
 <Workout workoutActivityType="Undated"/>
 <ActivitySummary dateComponents="2024-01-01"/>
 <ClinicalRecord type="x"/>
</HealthData>
"""


@pytest.fixture
def export(tmp_path):
    (tmp_path / "export.xml").write_text(XML)
    return str(tmp_path / "export.xml")


def test_extract(spark, export):
    kept, windows = extract(spark, export)
    assert [(r.start, r.end) for r in windows.collect()] == [("2024-01-01 10:00:00 -0800", "2024-01-01 11:00:00 -0800")]
    assert [(r._type, r._value) for r in kept["Record"].collect()] == [("HR", "7 < 8")]
    assert kept["Correlation"].count() == 1 and kept["Workout"].count() == 2
    assert set(kept) == {"Workout", "Record", "Correlation", "ExportDate", "Me"}
    assert {r.kind: r.n for r in kept_counts(kept).collect()} == {"Workout": 2, "Record": 1, "Correlation": 1}


def test_forced_types_and_summaries(spark, export):
    kept, _ = extract(spark, export, force_types=["Steps"], include_activity_summaries=True)
    assert sorted(r._type for r in kept["Record"].collect()) == ["HR", "Steps"]
    assert kept["ActivitySummary"].count() == 1


def test_write_and_read_back(spark, export, tmp_path):
    out = str(tmp_path / "out")
    counts = write_extract(spark, export, out)
    assert sum(r.n for r in counts.collect()) == 4
    assert root_attributes(spark, f"{out}/Record") == 'locale="en_US"'
    back = scan_elements(spark, f"{out}/Record", "Record").collect()
    assert [(r._type, r._value, r._startDate) for r in back] == [("HR", "7 < 8", "2024-01-01 10:00:00 -0800")]
    assert scan_elements(spark, f"{out}/Correlation", "Correlation").first().Record._type == "Sys"


def test_no_root_or_no_workout(spark, tmp_path):
    (tmp_path / "x.xml").write_text("<Other/>")
    with pytest.raises(ValueError):
        root_attributes(spark, str(tmp_path / "x.xml"))
    (tmp_path / "y.xml").write_text('<HealthData>\n<Workout a="1"/>\n</HealthData>')
    with pytest.raises(ValueError):
        extract(spark, str(tmp_path / "y.xml"))


def test_given_schema_and_namespace(spark, tmp_path):
    (tmp_path / "n.xml").write_text('<h:HealthData xmlns:h="u">\n<h:Workout startDate="1" endDate=""/>\n</h:HealthData>')
    rows = scan_elements(spark, str(tmp_path / "n.xml"), "Workout", "_startDate string, _endDate string").collect()
    assert [(r.subject.rsplit("/", 1)[-1], *r[1:]) for r in rows] == [("n.xml", "1", "")]


def test_owners_with_one_file_name_keep_apart(spark, tmp_path):
    run = '<Workout startDate="2024-01-01 10:00:00" endDate="2024-01-01 11:00:00"/>'
    record = '<Record type="{}" startDate="{}" endDate="{}"><MetadataEntry key="a" value="1"/>{}</Record>'
    two = '<MetadataEntry key="b" value="2"/>'
    inside, outside = ("2024-01-01 10:05:00", "2024-01-01 10:06:00"), ("2024-01-03 10:05:00", "2024-01-03 10:06:00")
    files = {
        "c": f"""<HealthData
 locale="x">
{run}
{record.format("HR", *inside, two)}
<Correlation device="cuff" startDate="2024-01-01 10:05:00" endDate="2024-01-01 10:06:00">
 {record.format("Sys", *inside, "")}
 {run}
</Correlation>
</HealthData>""",
        "d": f"""<HealthData locale="y">
<Workout startDate="2024-01-03 10:00:00" endDate="2024-01-03 11:00:00"/>
{record.format("HR", *inside, two)}
{record.format("Steps", *outside, "")}
</HealthData>""",
    }
    for name, text in files.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "export.xml").write_text(text)
    path = [str(tmp_path / name / "export.xml") for name in files]
    kept, _ = extract(spark, path)
    assert sorted((r.subject.split("/")[-2], r._type) for r in kept["Record"].collect()) == [("c", "HR"), ("d", "Steps")]
    assert sorted(r.subject.split("/")[-2] for r in kept["Workout"].collect()) == ["c", "d"]
    write_extract(spark, path, str(tmp_path / "out"))
    owners = {r.folder: (r.subject.split("/")[-2], r.attributes) for r in spark.read.parquet(str(tmp_path / "out" / "owners")).collect()}
    back = scan_elements(spark, str(tmp_path / "out" / "Record"), "Record").collect()
    assert sorted((*owners[r.subject], r._type) for r in back) == [("c", 'locale="x"', "HR"), ("d", 'locale="y"', "Steps")]
    for folder, (_, attributes) in owners.items():
        assert root_attributes(spark, str(tmp_path / "out" / "Record" / f"subject={folder}")) == attributes


def test_records_without_dates_or_type(spark, tmp_path):
    run = '<Workout startDate="2024-01-01 10:00:00" endDate="2024-01-01 11:00:00"/>'
    (tmp_path / "e.xml").write_text(f'<HealthData>\n{run}\n<Record startDate="2024-01-01 10:00:00"/>\n</HealthData>')
    assert extract(spark, str(tmp_path / "e.xml"), force_types=["HR"])[0]["Record"].count() == 0


def test_counts(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "kind string")
    assert {r.kind: r.n for r in element_counts(df).collect()} == {"a": 2, "b": 1}


def test_exports_of_one_name_are_of_two_owners(spark, tmp_path):
    for person in "cd":
        (tmp_path / person).mkdir()
        (tmp_path / person / "export.xml").write_text('<HealthData>\n<Workout startDate="1" endDate="2"/>\n</HealthData>')
    rows = scan_elements(spark, str(tmp_path / "*"), "Workout", "_startDate string, _endDate string").collect()
    assert len({r.subject for r in rows}) == 2
