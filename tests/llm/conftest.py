from __future__ import annotations

import pytest

from tests.conftest import spark  # noqa: F401


@pytest.fixture(scope="session")
def odd_documents(spark):  # noqa: F811
    """Nulls, empty and long texts, repeated rows, and columns whose names the operators use inside."""
    long = " ".join(f"word{i % 977} of the" for i in range(20_000))
    rows = [
        (1, "The first line of a small text here.\nThe second line of that same small text.", "en", "s0"),
        (2, "The first line of a small text here.\nThe second line of that same small text.", "en", "s0"),
        (3, "The first line of one small text here.\nanother one", "en", None),
        (4, "", "en", "s1"),
        (5, None, None, "s1"),
        (6, " \n\t ", "de", "s2"),
        (7, long, "de", "s2"),
        (7, long, "de", "s2"),
        (None, "no id at all in this one", "fr", "s0"),
        (9, "x", None, None),
    ]
    schema = "doc_id long, text string, lang string, source string"
    df = spark.createDataFrame(rows, schema)
    for name in ("n", "class", "size", "groups", "line", "key", "row", "bits", "salt", "part", "held", "length"):
        df = df.selectExpr("*", f"'{name}' AS `{name}`")
    return df
