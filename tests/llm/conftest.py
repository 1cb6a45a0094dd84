from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from conftest_text import text_of  # noqa: E402

@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text, source, lang): nulls, empty and very long texts, ties, repeated rows."""
    long = text_of(5, 30_000)
    return [
        (1, text_of(1, 200), "a", "en"), (2, text_of(1, 200), "a", "en"), (3, text_of(2, 150), "b", None),
        (4, "", "a", "en"), (5, None, "b", "en"), (6, None, None, None), (7, "   \n\t ", "a", "en"),
        (8, "one two", "c", "de"), (9, "one two", "c", "de"), (10, long, "b", "en"), (11, text_of(5, 30_000) + " x", "b", "en"),
        (12, "Ünï cödé ñandú 漢字 🙂 é", None, "es"), (13, "a" * 3000, "a", "en"), (14, "same " * 500, "b", "en"),
        (15, "same " * 499, "b", "en"), (None, text_of(3, 80), "a", "en"), (3, text_of(2, 150), "b", None),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The odd rows as documents, with columns whose names the operators use inside."""
    schema = "doc_id long, text string, source string, lang string"
    docs = spark.createDataFrame(odd_rows, schema).selectExpr(
        "*", "1 AS row", "2 AS size", "'x' AS key", "3 AS h", "4 AS rep", "5 AS place", "6 AS digest", "7 AS next", "8 AS hashes", "9 AS label",
        *[f"{k} AS {name}" for k, name in enumerate(("_id _source _digest _text _copy _rank _kept _kept_text _times _more id `from` mixed times more "
                                                     "copy rank first least root class head bag").split())])
    return docs.repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("false")
