import io
import random

import pytest
from pyspark.sql import functions as F

from recordloom.functions import numbers as N
from recordloom.functions import text as T
from recordloom.sources.ledger_files import detect_layout


def apply(spark, expression, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in rows.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


DESCRIPTIONS = {
    "Venmo-Payment-00000000": "Venmo Payment",
    "Venmo-Payment-12345678": "Venmo Payment",
    "Foo (Account ****0000)": "Foo",
    "XXXX1234 BAR_baz": "Bar Baz",
    "o'neil 7eleven a.b": "O'Neil 7Eleven A.B",
    "PAY -A0000 ": "Pay",
    "x-999999999-12": "X",
    "ACME--corp__inc": "Acme Corp Inc",
    "A B-12": "A B 12",
    "Chk ***": "Chk",
    " café ZÜRICH ": "Café Zürich",
    "": "",
}
DATES = {
    "1/2/2025": "2025-01-02",
    "2025-01-02": "2025-01-02",
    "": "",
    "1/2": "1/2",
    "a/b/c/d": "a/b/c/d",
    "123/4/25": "25-123-04",
    "//": "-00-00",
}
AMOUNTS = {"$5": 0.0, "1,000.5": 1000.5, "": 0.0, "-45.10": -45.1, " 7 ": 7.0, "1_0": 10.0, "1d": 0.0, "nan": None}
DOLLARS = {"$1,600.00": 1600.0, "(5)": 0.0, "0": 0.0, " $1.25 ": 1.25}
VALUES = {
    "$1,600.00": 1600.0,
    "(123)": -123.0,
    "(1,234.5)": -1234.5,
    "1_000": 1000.0,
    "1e3": 1000.0,
    " 7 ": 7.0,
    "+.5": 0.5,
    "5.": 5.0,
    "NA": None,
    "n/a": None,
    "Null": None,
    "-": None,
    "": None,
    "(-5)": None,
    "( 5 )": None,
    "$ (5)": None,
    "1d": None,
    "abc": None,
    "0x1": None,
    "nan": None,
    None: None,
}
SHORTSTATS = {
    " 3 files changed, 10 insertions(+), 2 deletions(-)": 12,
    " 1 file changed, 1 deletion(-)": 1,
    " 1 file changed, 0 insertions(+), 0 deletions(-)": 0,
    "4f1c2d": 0,
    "": 0,
}
NAMES = {
    "https://x.example/a/next.js.git": "next.js",
    "https://x.example/a/b/": "b",
    "b": "b",
}


@pytest.mark.parametrize(
    "expression,cases",
    [
        (T.normalize_description, DESCRIPTIONS),
        (T.normalize_date, DATES),
        (N.parse_amount, AMOUNTS),
        (N.parse_dollar, DOLLARS),
        (N.parse_value, VALUES),
        (T.shortstat_lines, SHORTSTATS),
        (T.repo_name, NAMES),
    ],
)
def test_cases(spark, expression, cases):
    assert apply(spark, expression, cases) == list(cases.values())


def test_title_case_of_random_texts(spark):
    rnd = random.Random(3)
    letters = "abAB zZ '-_7.\tßÉéǆﬁΩσς中İı1"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 9))) for _ in range(2000)]
    assert apply(spark, T.title_case, texts) == [t.title() for t in texts]


def test_field_name(spark):
    rows = spark.createDataFrame([("1040", "1z"), ("D", "1a"), ("X-1", "2.b")], "f string, l string")
    found = [r[0] for r in rows.select(T.field_name(F.col("f"), F.col("l"))).collect()]
    assert found == ["f_1040_1z", "f_d_1a", "f_x_1_2b"]


def test_repo_url(spark):
    urls = ["https://github.com/vercel/next.js", "http://github.com/a/b/tree", "https://example.org/a/b"]
    assert apply(spark, T.repo_owner, urls) == ["vercel", "a", None]
    assert apply(spark, T.repo_short_name, urls) == ["next", "b", None]


def test_line_count(spark):
    texts = ["", "a", "a\n", "a\r\nb\rc", "\n\n", "\r", "\r\n\r\n", "\n\r", "a b", "x\x85y"]
    expected = [sum(1 for _ in io.TextIOWrapper(io.BytesIO(t.encode()), "utf-8")) for t in texts]
    assert apply(spark, T.line_count, texts) == expected


def test_text_sniff(spark):
    wide = "世"
    heads = [
        b"",
        b"abc",
        b"\xc3",
        b"a" * 5000 + b"\xc3",
        b"a" * 4095 + b"\xc3",
        b"a" * 8191 + "é".encode(),
        b"a" * 8191 + b"\xffabc",
        (wide * 3000).encode(),
        (wide * 3000).encode()[:-1],
        (wide * 7000).encode()[:-1],
        (wide * 2730 + "ab").encode() + b"\xff",
        (wide * 5000).encode() + b"\xff",
        b"a" * 9000 + b"\xff",
        b"a" * 3000 + b"\xff",
        b"a" * 8190 + b"\xe0\x80" + b"a",
        b"a" * 8189 + "\U0001f600".encode(),
        b"a" * 8191 + b"\xed",
    ]

    def decodes(data):
        try:
            io.TextIOWrapper(io.BytesIO(data), encoding="utf-8").read(4096)
            return True
        except UnicodeDecodeError:
            return False

    assert apply(spark, T.is_text, [bytearray(h) for h in heads], "binary") == [decodes(h) for h in heads]


def test_days_are_elapsed_days(spark):
    rows = spark.createDataFrame(
        [("2024-01-01T23:00:00+00:00", "2024-01-02T01:00:00+00:00"), ("2024-01-02T00:00:00+02:00", "2024-01-01T21:00:00+00:00")],
        "a string, b string",
    )
    days = N.days_between(F.col("a").cast("timestamp"), F.col("b").cast("timestamp"))
    assert [r[0] for r in rows.select(days).collect()] == [0, -1]


def test_pct_and_ratio(spark):
    rows = spark.createDataFrame([(10.0, -5.0), (1.0, 0.0), (None, 2.0), (3.0, None), (110.0, 100.0)], "a double, b double")
    found = [tuple(r) for r in rows.select(N.pct_change(F.col("a"), F.col("b")), N.ratio_pct(F.col("a"), F.col("b"))).collect()]
    assert found == [(300.0, -200.0), (None, None), (None, None), (None, None), (pytest.approx(10.0), pytest.approx(110.0))]


def test_detect_layout(spark):
    a = "Transaction date,Description,Type,Amount"
    b = "Transaction Date,Transaction Description,Transaction Type,Debit,Credit,Balance"
    headers = [a, b, a.upper() + ", More", b + ",Description,Type,Amount", "a,b", '"Transaction date",Description,Type,Amount', ""]
    assert apply(spark, detect_layout, headers) == ["wealthfront", "discover", "wealthfront", "discover", None, None, None]


def test_sum_keeps_amounts_that_do_not_fit(spark):
    rows = spark.createDataFrame([(1, 0.1), (1, 0.2), (1, 0.3), (2, 1e300), (2, 1.0), (3, None)], "k int, a double")
    found = rows.groupBy("k").agg(N.exact_sum(F.col("a"), N.as_decimal(F.col("a"))).alias("s")).orderBy("k").collect()
    assert [r.s for r in found] == [0.6, 1e300, None]
