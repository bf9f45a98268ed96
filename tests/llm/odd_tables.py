"""Fixtures of small tables with the awkward rows that every operator must stand."""

import pytest

LONG = "alpha beta gamma delta epsilon zeta eta theta " * 4000


@pytest.fixture
def odd_docs(spark):
    """Nulls, empty and very long texts, repeated rows, and columns that clash with working names."""
    rows = [
        (1, None, None, None, "x", 1),
        (2, "", "en", "a", "y", 2),
        (3, LONG, "en", "a", None, 3),
        (4, "one two", None, "b", "z", 4),
        (4, "one two", None, "b", "z", 4),
        (5, "one two", "en", "b", "z", 5),
        (6, "été \U0001f389 漢字 \x00 \x1c", "fr", None, "", None),
        (7, " \n\t ", "en", "c", "", 0),
    ]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, score string, n long"
    )


@pytest.fixture
def no_docs(odd_docs):
    return odd_docs.where("false")

SMALL = "/root/testdata/sf0.001"
