import math
import random

import pytest

from cobaltmill.llm import topk


def brute(rows, k, every):
    whole = [(i, tuple(math.floor(64 * x) for x in v)) for i, v in rows
             if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out, seen = [], {}
    for i, v in whole:
        if i % every == 0:
            seen[i] = min(v, seen.get(i, v))
    for q, v in seen.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in whole if i != q and len(w) == len(v))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def run(spark, rows, k, every, monkeypatch=None, **sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(topk, name, value)
    points = topk.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    queries = points.filter(f"vec_id % {every} = 0").withColumnRenamed("vec_id", "query_id")
    return sorted(tuple(r) for r in topk.top_k(queries, points, k=k, block=40).collect())


def vectors(n, dim, seed=3):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, .3) for _ in range(dim)] for _ in range(6)]
    return [(i, [float(f"{x + rnd.gauss(0, .15):.5f}") for x in rnd.choice(centres)]) for i in range(n)]


def test_many_shards_and_groups(spark, monkeypatch):
    index = topk.build_index
    monkeypatch.setattr(topk, "build_index", lambda points: index(points, cells=1000, group=2))
    monkeypatch.setattr(topk, "LEAF", 8)
    rows = vectors(900, 8)
    assert run(spark, rows, 20, 10) == brute(as_floats(rows), 20, 10)


def test_groups_that_cannot_gain_are_not_sent(spark, monkeypatch):
    """On vectors in tight clusters far apart most pairs of a block and a group fall to the bounds."""
    index, sent = topk.build_index, []
    stored = topk.materialise

    def seen(df, tag):
        table = stored(df, tag)
        if tag == "top-pairs":
            sent.append(table.count())
        if tag == "ball-trees":
            sent.append(table.select("dim", "grp").distinct().count())
        return table

    monkeypatch.setattr(topk, "materialise", seen)
    monkeypatch.setattr(topk, "build_index", lambda points: index(points, cells=400, group=1))
    rnd = random.Random(7)
    rows = [(i, [float(round(5 * (i % 8 == d) + rnd.gauss(0, .02), 4)) for d in range(8)]) for i in range(1600)]
    assert run(spark, rows, 5, 10) == brute(as_floats(rows), 5, 10)
    groups, first, rest = sent
    assert groups >= 20 and first + rest < groups * first / 2


def as_floats(rows):
    import numpy as np
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]


def test_odd_rows(spark):
    rows = vectors(60, 4) + [
        (100, None), (110, []), (120, [1.0, None, 2.0, 3.0]), (130, [float("nan"), 0.0, 0.0, 0.0]),
        (140, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0, 1.0, 1.0, 1.0]), (150, [1.0, 2.0]), (160, [0.5, 0.5]),
        (170, [3.0]), (200, [0.1, 0.1, 0.1, 0.1]), (200, [0.1, 0.1, 0.1, 0.1]), (205, [0.0, 0.0, 0.0, 0.0])]
    rows += [(300 + i, [0.2, 0.2, 0.2, 0.2]) for i in range(40)]  # ties
    assert run(spark, rows, 5, 10) == brute(as_floats(rows), 5, 10)


def test_fewer_candidates_than_k_and_empty(spark):
    assert run(spark, [(0, [1.0, 0.0]), (3, [0.5, 0.5])], 20, 10) == [(0, 1, 3, 64 * 32)]
    assert run(spark, [], 20, 10) == []
    assert run(spark, [(1, [1.0])], 20, 10) == []


def test_wide_values(spark):
    rows = [(i, [float((i * 7919) % 3001 - 1500), float(i)]) for i in range(200)]
    assert run(spark, rows, 3, 50) == brute(as_floats(rows), 3, 50)


@pytest.mark.parametrize("value,kind", [(1, "int8"), (1000, "int16"), (10 ** 6, "int32"), (10 ** 12, "float64")])
def test_packed_types(value, kind):
    import numpy as np
    assert topk._small(np.array([[float(value)]])) == kind
