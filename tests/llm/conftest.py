import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and columns whose names clash with results'."""
    rows = [
        (1, None, None, 0.5),
        (2, "", "en", 0.5),
        (3, "one two three four five six seven", "en", 0.5),
        (3, "one two three four five six seven", "en", 0.5),
        (None, "a text without an id, but with letters", "fr", None),
        (4, "!!! 123 ???\n\n", None, 0.1),
        (5, "été Ünï \U0001f600 it's\tfine " * 3, "fr", 0.1),
        (6, "long words of one document " * 20000, "en", 0.1),
        (7, "one two three four five six eight", "en", None),
    ]
    names = "doc_id long, text string, lang string, score double"
    extra = "score as fp, score as spans, score as number, score as fingerprint, score as contaminated, score as keep"
    return spark.createDataFrame(rows, names).selectExpr("*", *extra.split(", "))


@pytest.fixture
def sf():
    if not os.path.isdir(SF):
        pytest.skip("test tables are not here")
    return SF
