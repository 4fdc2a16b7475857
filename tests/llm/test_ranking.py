import math
import random
import re
from collections import Counter

import pytest

from cobaltmill.llm import ranking

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    asked = {}
    for i, text in items:
        asked.setdefault(i, set()).update(terms(text))
    out = []
    for item, own in asked.items():
        found = []
        for i, c in counted:
            m = 50 + 50 * sum(c.values()) * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * (10 ** 9 * c[t] // (1000 * c[t] + 20 * m)) for t in own if t in c)
            if score > 0:
                found.append((-score, i is None, i))
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, n + 1, i, -s) for n, (s, _, i) in enumerate(found[:k])]
    return sorted(out, key=str)


def run(docs, items, k, index=None, **sizes):
    found = ranking.search(ranking.build_index(docs, **index or {}), ranking.item_terms(items), k, **sizes).collect()
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in found), key=str)


def corpus(spark, n, seed=5):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(words[min(int(rnd.expovariate(.03)), 299)] for _ in range(rnd.randint(0, 120)))) for i in range(n)]
    asked = [(i, " ".join(words[int(rnd.random() ** 2 * 300)] for _ in range(rnd.randint(0, 25)))) for i in range(40)]
    return rows, asked


@pytest.mark.parametrize("docs_in_shard,block,window", [(60, 8, 16), (1 << 14, 128, 1 << 12), (7, 2, 3)])
def test_shards_blocks_windows(spark, docs_in_shard, block, window):
    rows, asked = corpus(spark, 700)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = run(docs, spark.createDataFrame(asked, "item_id long, text string"), 10,
                {"shard_docs": docs_in_shard, "block": block, "size": 1000}, window=window, block_items=9, first_of=3)
    assert found == brute(rows, asked, 10) and len(found) > 300


def test_skips_blocks():
    """A rare term decides: most blocks of the common one are never unpacked."""
    import numpy as np
    n = 5000
    rare = np.arange(7, n, 500)
    hashes = [np.array([1, 9] if i in set(rare.tolist()) else [1], np.uint64) for i in range(n)]
    sizes = np.array([len(h) for h in hashes])
    lists, docs = ranking._shard(0, np.arange(n), sizes, np.concatenate(hashes))
    rows = {r["term"]: {**r, "weight": w} for r, w in zip(lists.to_pylist(), (1, 5000))}
    built = {t: ranking._List(row, lambda s: 50 + 0 * s) for t, row in rows.items()}
    heap = ranking._Heap(5, 0)
    ranking._walk(list(built.values()), np.arange(n), np.full(n, 50), heap)
    assert sorted(-i for _, i, _ in heap.rows) == rare[:5].tolist()
    assert len(built[1].open) < 0.95 * len(built[1].lasts)


def test_odd_rows(spark, odd_docs, clashing):
    asked = [(1, "the SHARED line, of many; words"), (1, "and ten"), (2, None), (3, ""), (4, "nowhere zzz"), (None, "one two"),
             (5, "日本 Größe end"), (6, "a" * 30000 + " w5x5"), (7, "123!!456"), (8, "the the the line line")]
    items = spark.createDataFrame(asked, "item_id long, text string")
    want = brute([tuple(r) for r in odd_docs.select("doc_id", "text").collect()], asked, 4)
    assert run(odd_docs, items, 4) == want
    assert run(clashing, items, 4) == want


def test_ties_go_to_smaller_ids(spark):
    rows = [(i, "same text here") for i in range(300, 0, -1)] + [(None, "same text here"), (400, "other words")]
    docs, items = spark.createDataFrame(rows, "doc_id long, text string"), [(1, "text")]
    found = run(docs.repartition(5), spark.createDataFrame(items, "item_id long, text string"), 20)
    assert found == brute(rows, items, 20) and {r[2] for r in found} == set(range(1, 21))


def test_long_frequencies(spark):
    rows = [(1, "x " * 70000 + "y"), (2, "x y z"), (3, "z " * 300)]
    items = [(1, "x z"), (2, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert run(docs, spark.createDataFrame(items, "item_id long, text string"), 5) == brute(rows, items, 5)


def test_empty(spark, no_docs, odd_docs):
    items = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert run(no_docs, items, 5) == []
    assert run(odd_docs, items.limit(0), 5) == []
