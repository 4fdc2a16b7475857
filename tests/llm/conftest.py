import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
for folder in (ROOT, os.path.join(ROOT, "tests"), os.path.dirname(os.path.abspath(__file__))):
    if folder not in sys.path:
        sys.path.insert(0, folder)

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside or return.
CLASHES = ("size", "weight", "target", "key", "node", "keys", "ids", "decoded", "n_lines", "n_removed", "score",
           "position", "copy", "site", "first", "dim", "url2", "row", "span", "need", "head_id", "head_hash", "head_row",
           "_id", "_hash", "_row", "owner", "_lines", "_gone", "_d", "_t1", "_t2", "_line", "_copy", "_n", "_rows",
           "_epochs", "_chosen", "_doc_id", "_source", "_text_hash")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls everywhere, empty and long texts, repeated rows, one id with two texts."""
    line = "one two three four five six seven eight nine ten"
    rows = [
        (1, "\n".join([line, "the shared line of many words here", "x"]), "en", "a", 10),
        (2, None, "en", "a", None), (3, "", "de", None, 0), (4, " \t\n ", None, "b", 4),
        (5, line, "en", "b", 5), (6, line, "en", "c", 5), (6, line, "en", "c", 5), (7, line.upper(), "en", None, 5),
        (8, "Größe ünd Maß, naïve Σίσυφος 日本 \U0001f600 \x1c\x85 end", None, "c", 9),
        (8, "another text under the same id as before it", "en", "c", 9),
        (None, "a row without an id", "en", "a", 1), (None, line, None, None, None),
        (9, " ".join(f"w{i % 977}x{i}" for i in range(60000)), "en", "a", 1), (10, "a" * 30000, "fr", "a", 2),
        (11, "123 456 !!", "en", "b", 3), (12, "<|endoftext|>x <|startoftext|>", "en", "b", 3),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(odd_docs):
    from pyspark.sql import functions as F
    return odd_docs.select("*", *[F.lit(7).alias(c) for c in CLASHES])


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame(
        [(1, 1, 0), (5, 0, 0), (6, None, 1), (None, 1, 1), (6, 0, 0)], "doc_id long, quality int, toxic int")
