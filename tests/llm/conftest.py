import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SCHEMA = "doc_id long, text string, lang string, source string, key string, size long, n long"
PROSE = (
    "the river bends twice before it meets the old stone bridge and the miller counts boats that pass under it "
    "every morning while his daughter writes down the names of strangers who stop for bread"
)


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls everywhere, empty, blank and very long texts, ties and repeated rows; names that clash with inner ones."""
    long = " ".join(f"word{i % 997}x{i % 31}" for i in range(60_000))
    texts = [
        None, "", " \t\n", "a", PROSE, PROSE, PROSE + " again", long, "no one is home.", PROSE.upper(), "é ñ ü ß 漢字 mixed",
        "call +1 (229) 555-4838 or mail Kim.Ray@corp.example.de now",
    ]
    rows = [(i, t, "en" if i % 3 else None, "web" if i % 2 else None, "k", i, 7) for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, PROSE, None, None, None, None, None), (None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
