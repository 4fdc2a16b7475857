from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cobaltmill.llm import mixing
from cobaltmill.session import materialise


def water(sizes, weights, share):
    """Targets by resharing until none is above twice its size."""
    total, capped = share * sum(sizes.values()), set()
    while True:
        open_ = [s for s in sizes if s not in capped]
        rest = total - sum(2 * sizes[s] for s in capped)
        deal = {s: rest * weights[s] / sum(weights[t] for t in open_) for s in open_}
        above = {s for s in open_ if deal[s] > 2 * sizes[s]}
        if not above:
            return {**deal, **{s: 2 * sizes[s] for s in capped}}
        capped |= above


def test_targets_are_reshared(spark):
    sizes = {"a": 10, "b": 1000, "c": 3, "d": 500, "e": 0, None: 70}
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    found = {r["source"]: r["target"] for r in mixing.targets(rows).collect()}
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    assert found == pytest.approx(water(sizes, weights, 1.5))


def test_odd_rows(clashing, labels):
    rows = mixing.mix_documents(clashing, labels).collect()
    assert len(rows) == 16
    sums = defaultdict(int)
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["size"] >= 0
        sums[r["source"]] += r["taken"]
    longest = defaultdict(int)
    for r in rows:
        longest[r["source"]] = max(longest[r["source"]], r["size"])
    for r in rows:
        assert abs(sums[r["source"]] - r["target"]) <= max(longest[r["source"]] / 2, 1e-6)
    assert {r["size"] for r in rows if r["doc_id"] in (2, 3, 4)} == {0}
    again = mixing.mix_documents(clashing, labels).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_keys_follow_the_method(spark):
    """The chosen rows are those with the smallest keys, whatever the buckets are."""
    rows = spark.createDataFrame(
        [(i, f"s{i % 3}" if i % 2 else "s0", (i * 37) % 50, 1.0 + i % 4, i) for i in range(3000)],
        "doc_id long, source string, size long, weight double, text_hash long")
    mixed = mixing.mix(rows, mixing.targets(rows)).collect()
    by = defaultdict(list)
    for r in mixed:
        by[r["source"]].append(r)
    for group in by.values():
        running, rest = 0, group[0]["target"] - group[0]["epochs"] * group[0]["source_size"]
        for r in sorted(group, key=lambda r: (r["sample_key"], r["doc_id"])):
            running += r["size"]
            if r["size"]:
                assert r["chosen"] == (running - r["size"] / 2 <= rest)


def test_heavy_rows_are_likelier(spark):
    rows = spark.range(20000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") < 10000, "a").otherwise("b").alias("source"),
        F.lit(10).alias("size"), F.when(F.col("id") % 2 == 0, 4.0).otherwise(1.0).alias("weight"),
        F.col("id").alias("text_hash"))
    goal = spark.createDataFrame([("a", 100000, 30000.0), ("b", 100000, 0.0)],
                                 "source string, source_size long, target double")
    chosen = mixing.mix(rows, goal).filter("chosen = 1").groupBy((F.col("doc_id") % 2).alias("odd")).count()
    counts = {r["odd"]: r["count"] for r in chosen.collect()}
    assert 2900 <= counts[0] + counts[1] <= 3100
    assert counts[0] > 2.5 * counts[1]


def test_take_repeats_rows(spark, odd_docs, labels):
    docs = materialise(odd_docs, "test-docs")
    mixed = mixing.mix_documents(docs, labels)
    out = mixing.take(docs, mixed)
    assert out.columns == docs.columns
    want = mixed.agg(F.sum(F.when(F.col("size") > 0, F.col("epochs") + F.col("chosen")))).first()[0]
    assert out.count() == want


def test_empty(no_docs, labels):
    assert mixing.mix_documents(no_docs, labels).count() == 0
    assert mixing.take(no_docs, mixing.mix_documents(no_docs, labels)).count() == 0
