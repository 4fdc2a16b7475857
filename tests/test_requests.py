"""Trends, ranks, subtotals, pivots and quantiles of analysis requests against small brute-force versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cobaltmill.operators import levels
from cobaltmill.operators.quantiles import exact_quantiles
from cobaltmill.operators.trends import add_trends
from cobaltmill.plans.analysis import UnknownColumn, run_spec

ROWS = "g string, t int, v double, id long"


def rows_of(n, seed=1, groups=("a", "a", "a", "b", None)):
    rnd = random.Random(seed)
    return [(rnd.choice(groups), rnd.randrange(n // 3), None if rnd.random() < .1 else float(rnd.randrange(-50, 50)), i)
            for i in range(n)]


def brute_trends(rows, n):
    out = {}
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], (r[2] is not None, r[2] or 0), r[3]))
        total = sum(r[2] for r in own if r[2] is not None)
        for i, r in enumerate(own):
            window = [x[2] for x in own[max(0, i - n + 1):i + 1] if x[2] is not None]
            before = own[i - 1][2] if i else None
            moved = None if before is None or r[2] is None else r[2] - before
            out[r[3]] = (
                i + 1, 1 + sum(x[1] < r[1] for x in own), len({x[1] for x in own if x[1] <= r[1]}),
                sum(x[2] or 0 for x in own[:i + 1]), sum(window) / len(window) if window else None, moved,
                None if moved is None or before == 0 else 100 * moved / before,
                None if r[2] is None or total == 0 else r[2] / total)
    return out


def measures(n):
    return [{"kind": "row_number", "name": "r0"}, {"kind": "rank", "name": "r1"}, {"kind": "dense_rank", "name": "r2"},
            *[{"kind": k, "name": f"m{i}", "column": "v", "n": n} for i, k in enumerate(
                ("running_sum", "moving_mean", "change", "change_pct", "share"))]]


@pytest.mark.parametrize("bits, n", [(3, 4), (2, 2), (20, 7), (4, 1)])
def test_trends_do_not_depend_on_blocks(spark, bits, n):
    rows = rows_of(260)
    df = spark.createDataFrame(rows, ROWS).repartition(5)
    got = add_trends(df, ["g"], [("t", False)], measures(n), bits=bits).collect()
    want = brute_trends(rows, n)
    assert len(got) == len(rows)
    for r in got:
        found = tuple(r[c] for c in ("r0", "r1", "r2", "m0", "m1", "m2", "m3", "m4"))
        for a, b in zip(found, want[r["id"]]):
            assert (a is None and b is None) or a == pytest.approx(b, abs=1e-9)


def test_a_hot_group_and_no_group(spark):
    rows = rows_of(400, 3, ("hot",) * 20 + ("b",))
    df = spark.createDataFrame(rows, ROWS)
    want = brute_trends([("all", *r[1:]) for r in rows], 3)
    got = add_trends(df.drop("g"), [], [("t", False)], measures(3), bits=4).collect()
    assert {r["id"]: (r["r0"], r["r1"], r["r2"], r["m0"]) for r in got} == {i: w[:4] for i, w in want.items()}


def test_no_window_holds_a_group(spark):
    df = spark.createDataFrame(rows_of(50), ROWS)
    plan = add_trends(df, ["g"], [("t", True)], measures(3))._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.split("\n") if "Window " in line and "WindowGroupLimit" not in line]
    assert windows and all("__block" in line or "__part" in line for line in windows)


def test_trend_mistakes(spark):
    df = spark.createDataFrame(rows_of(5), ROWS)
    for bad in ({"kind": "median", "name": "x"}, {"kind": "share", "name": "x"}, {"kind": "moving_mean", "name": "x", "column": "v", "n": 9}):
        with pytest.raises(ValueError):
            add_trends(df, ["g"], [("t", False)], [bad], bits=3)
    with pytest.raises(UnknownColumn):
        run_spec(df, {"trends": [{"kind": "share", "name": "x", "column": "nothing"}]})
    assert add_trends(df.limit(0), ["g"], [("t", False)], measures(2)).collect() == []


def test_a_trend_of_a_trend(spark):
    df = spark.createDataFrame([("a", i, float(i * i), i) for i in range(6)], ROWS)
    got = run_spec(df, {"trends": [
        {"kind": "change", "name": "speed", "column": "v", "by": ["g"], "order_by": [{"column": "t"}]},
        {"kind": "change", "name": "turn", "column": "speed", "by": ["g"], "order_by": [{"column": "t"}]}]}).orderBy("t").collect()
    assert [r["speed"] for r in got] == [None, 1, 3, 5, 7, 9] and [r["turn"] for r in got] == [None, None, 2, 2, 2, 2]


@pytest.mark.parametrize("sets", ["rollup", "cube", [["a"], ["b"], []]])
@pytest.mark.parametrize("agg", ["sum", "mean", "count", "max", "distinct"])
def test_levels(spark, sets, agg):
    rnd = random.Random(8)
    rows = [(rnd.choice(["x", "y", None]), rnd.choice(["p", "q", None]), rnd.choice([None, 1, 2, 5])) for _ in range(80)]
    df = spark.createDataFrame(rows, "a string, b string, v long")
    how = {"sum": sum, "mean": lambda v: sum(v) / len(v) if v else None, "max": lambda v: max(v, default=None),
           "distinct": lambda v: len(set(v))}
    want = set()
    for chosen in levels.grouping_sets(["a", "b"], sets):
        groups = {}
        for a, b, v in rows:
            groups.setdefault((a if "a" in chosen else None, b if "b" in chosen else None), []).append(v)
        level = 2 * ("a" not in chosen) + ("b" not in chosen)
        for k, vs in groups.items():
            known = [v for v in vs if v is not None]
            want.add((*k, level, len(vs) if agg == "count" else how[agg](known)))
    metric = {"agg": agg, "name": "m", **({} if agg == "count" else {"column": "v"})}
    got = run_spec(df, {"group_by": ["a", "b"], "subtotals": sets, "metrics": [metric]}).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_levels_copy_groups_only(spark):
    df = spark.range(1000).selectExpr("id % 3 AS a", "id % 2 AS b", "id AS v")
    plan = levels.grouped_levels(df, ["a", "b"], [{"agg": "sum", "column": "v", "name": "s"}], "cube")._jdf.queryExecution().optimizedPlan().toString()
    lines = [line.strip(" +-:") for line in plan.split("\n")]
    expand = next(i for i, line in enumerate(lines) if line.startswith("Expand"))
    assert any(line.startswith("Aggregate") for line in lines[expand + 1:])


def test_level_and_pivot_mistakes(spark):
    df = spark.createDataFrame([("x", "p", 1)], "a string, b string, v long")
    for bad in ({"subtotals": "all"}, {"subtotals": [["c"]]}, {"subtotals": "rollup", "metrics": [{"agg": "median", "column": "v", "name": "m"}]},
                {"pivot": {"column": "b"}, "metrics": [{"agg": "median", "column": "v", "name": "m"}]}):
        with pytest.raises(ValueError):
            run_spec(df, {"group_by": ["a"], "metrics": [{"agg": "sum", "column": "v", "name": "m"}], **bad})


def test_pivot_finds_its_columns(spark):
    df = spark.createDataFrame([("x", "p", 1), ("x", "q", 2), ("y", "p", 5), ("y", "p", 6), (None, "q", 9), ("y", None, 3)],
                               "a string, b string, v long")
    got = run_spec(df, {"group_by": ["a"], "pivot": {"column": "b"}, "metrics": [{"agg": "sum", "column": "v", "name": "m"}]})
    assert {tuple(r) for r in got.select("a", "p", "q", "null").collect()} == {("x", 1, 2, None), ("y", 11, None, 3)}


@pytest.mark.parametrize("accuracy", [10, 100, 2000])
def test_exact_quantiles(spark, accuracy):
    rnd = random.Random(5)
    rows = [("hot", rnd.choice([rnd.gauss(0, 1), 7.0, float(rnd.randrange(5))])) for _ in range(5000)]
    rows += [("b", float(i)) for i in range(7)] + [("one", 3.5), ("none", None), (None, 1.0), (None, 2.0), ("hot", float("nan"))]
    shares = {"p0": 0.0, "low": .013, "mid": .5, "high": .9, "p1": 1.0}
    got = exact_quantiles(spark.createDataFrame(rows, "k string, v double").repartition(4), ["k"], "v", shares, accuracy).collect()
    by = {}
    for k, v in rows:
        if v is not None and not math.isnan(v):
            by.setdefault(k, []).append(v)
    assert {r["k"] for r in got} == set(by)
    for r in got:
        for name, p in shares.items():
            assert r[name] == pytest.approx(np.quantile(by[r["k"]], p), rel=1e-12, abs=1e-12)


def test_quantiles_of_a_whole_table(spark):
    df = spark.range(1001).withColumn("v", F.col("id") * 1.0)
    got = run_spec(df, {"metrics": [{"agg": "median", "column": "v", "name": "m"}, {"agg": "count", "name": "n"},
                                    {"agg": "quantile", "p": .25, "column": "id", "name": "q"}]}).collect()
    assert [tuple(r) for r in got] == [(500.0, 1001, 250.0)]
    assert exact_quantiles(df.limit(0), [], "v", {"m": .5}).collect() == []
