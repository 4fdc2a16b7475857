import itertools
import math
import re

import pytest

from cobaltmill.llm import audit


def fails(text, copy):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "E": copy,
            "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text))}


def brute(docs, labels):
    """Rows by walking every document through every order."""
    docs = [(i, t or "", s or "") for i, t, s in docs]
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t] = min(i, least.get(t, i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    judged = [(i, s, fails(t, i is not None and least[t] < i)) for i, t, s in docs]
    out = {}
    for part in {s for _, s, _ in judged}:
        own = [(i, f) for i, s, f in judged if s == part]
        shapley = dict.fromkeys("ABCDE", 0)
        steps = []
        for order in itertools.permutations("ABCDE"):
            left = own
            for n, f in enumerate(order):
                gone = [(i, x) for i, x in left if x[f]]
                left = [(i, x) for i, x in left if not x[f]]
                shapley[f] += len(gone)
                steps.append(("".join(order), n + 1, f, (
                    len(left), len(gone), sum(x[f] for _, x in own) - len(gone),
                    sum(x[f] and sum(x.values()) == 1 for _, x in own), sum(i in good for i, _ in gone),
                    sum(i in toxic for i, _ in gone))))
        for order, n, f, counts in steps:
            out[part, order, n] = (*counts, shapley[f])
    return out


def run(spark, docs, labels):
    found = audit.audit(audit.failure_cells(docs, labels)).collect()
    assert len(found) == len({(r["part"], r["filter_order"], r["step"]) for r in found})
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[n] for n in names) for r in found}


def plain(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("fixture", ["odd_docs", "clashing"])
def test_odd_rows(spark, request, labels, fixture):
    docs = request.getfixturevalue(fixture)
    want = brute(plain(docs.select("doc_id", "text", "source")), plain(labels))
    assert run(spark, docs, labels) == want


def test_clashing_names(spark, odd_docs, labels):
    from pyspark.sql import functions as F
    names = ("part", "mask", "words", "digest", "n", "good", "toxic", "edge", "shares", "n_at", "cells", "least", "best", "at")
    wide = odd_docs.select("*", *[F.lit(7).alias(c) for c in names])
    assert run(spark, wide, labels.withColumn("mask", F.lit(1))) == run(spark, odd_docs, labels)


def test_copies_and_repeated_rows(spark):
    long = " ".join(f"w{i}" for i in range(250))
    rows = [(5, long, "x"), (5, long, "x"), (5, long, "y"), (7, long, "x"), (9, long, None), (None, long, "x"),
            (None, long, "x"), (2, "A short $ text", "y"), (3, "A short $ text", "y"), (4, None, "x"), (6, "", "x"),
            (8, long + " w1" * 300, "y"), (8, "QUITE LOUD " * 150, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    labels = spark.createDataFrame([(5, 1, 0), (7, 1, 1), (7, 0, 1), (None, 1, 1), (99, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    assert run(spark, docs, labels) == brute(rows, plain(labels))


def test_paths():
    for n in range(1, 6):
        into, out = audit.path_counts(n)
        for state in range(1 << n):
            size = state.bit_count()
            assert into[state] == math.factorial(size) and out[state] == math.factorial(n - size)


def test_other_filters(spark):
    cells = spark.createDataFrame([("a", 0b01, 3, 1), ("a", 0b11, 4, 0), ("b", 0b00, 2, 2), ("b", 0b00, 1, 0)],
                                  "part string, mask int, n long, seen long")
    found = {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["seen_lost"], r["shapley"])
             for r in audit.audit(cells, "XY", ("seen",)).collect()}
    assert found == {
        ("a", "XY", 1): (0, 7, 0, 1, 10), ("a", "XY", 2): (0, 0, 4, 0, 4), ("a", "YX", 1): (3, 4, 0, 0, 4),
        ("a", "YX", 2): (0, 3, 4, 1, 10), ("b", "XY", 1): (3, 0, 0, 0, 0), ("b", "XY", 2): (3, 0, 0, 0, 0),
        ("b", "YX", 1): (3, 0, 0, 0, 0), ("b", "YX", 2): (3, 0, 0, 0, 0)}


def test_empty(spark, no_docs, labels, odd_docs):
    assert run(spark, no_docs, labels) == {}
    none = labels.limit(0)
    assert run(spark, odd_docs, none) == brute(plain(odd_docs.select("doc_id", "text", "source")), [])
