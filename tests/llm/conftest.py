import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, kept string, n long, `_id` string, word string"


@pytest.fixture(scope="session")
def make(spark):
    """A documents table from (doc_id, text, lang, source), with extra columns named like ours."""
    from recordloom.llm.ship import ship

    ship(spark)

    def build(*rows):
        full = [(*r, None if r[1] is None else len(r[1]), 7, "yes", 3, "x", "w") for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return build


LONG = " ".join(f"w{i}" for i in range(30_000))
PASSAGE = " ".join(f"p{i}" for i in range(40))


@pytest.fixture(scope="session")
def odd(make):
    """Nulls in each column, empty and blank texts, ties, copies, repeated rows, a very long text."""
    return make(
        (1, "a b  c", "en", "s"),
        (2, "a b\tc", "en", "s"),
        (3, "", "en", None),
        (4, None, None, "s"),
        (5, " \n\t ", "de", "t"),
        (None, "no id here", "de", "t"),
        (None, None, None, None),
        (6, LONG, "en", "t"),
        (7, PASSAGE + " tail", "en", "u"),
        (8, "head " + PASSAGE, "en", "u"),
        (9, PASSAGE + "\n" + PASSAGE, "en", "u"),
        (10, "same row", "en", "v"),
        (10, "same row", "en", "v"),
        (11, "Ünïcode wörds ÀÉ   ok \U0001f600", "fr", "v"),
        (12, "A b c", "en", "s"),
    )


@pytest.fixture(scope="session")
def none(make):
    return make()
