import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string"


@pytest.fixture(scope="session")
def sf(sf_dir):
    return sf_dir


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty, blank and very long texts, repeated rows, and a column whose name clashes."""
    long = " ".join(f"word{i % 977} the" for i in range(40_000))
    rows = [
        (1, "the cat sat on the mat today", "en", "a", 27, "x"),
        (2, "The cat sat on the mat today", "en", None, 27, None),
        (2, "The cat sat on the mat today", "en", None, 27, None),
        (3, None, None, None, None, None),
        (4, "", "de", "b", 0, "x"),
        (5, "  \n\t ", "de", "b", 5, "x"),
        (6, long, "en", "a", len(long), "x"),
        (7, "der hund lief über die straße", "de", "b", 30, "x"),
        (8, "12 34 !!", None, "b", 8, "x"),
        (None, "no id here", "en", "a", 10, "x"),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
