"""Exact quantiles of groups of any size, without a group's values in one buffer.

1. A quantile sketch of each group, merged map-side, brackets every wanted rank between two values.
2. Rows below the bracket are only counted; the values inside are counted one by one, both map-side first.
3. The values inside are range-sorted and their counts summed by blocks; the wanted ranks are read off.

The sketch's error is bounded, so a rank outside its bracket can't be; should one be, its group is done again
with an open bracket.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cobaltmill.operators.ordering import positions, running_before
from cobaltmill.session import materialise

#: Inverse of the sketch's error in ranks; a bracket is four errors wide.
ACCURACY = 2000
_INF = math.inf


def _ranks(share: Column, n: Column) -> tuple[Column, Column]:
    at = share * (n - 1)
    return F.floor(at).cast("long"), F.ceil(at).cast("long")


def _inside(values: DataFrame, brackets: DataFrame) -> DataFrame:
    """``key, part, value, n, before``: values in their brackets, and how many rows come before."""
    met = values.join(brackets, "key").filter(F.col("value") <= F.col("high"))
    cell = F.when(F.col("value") >= F.col("low"), F.col("value")).alias("value")
    counted = materialise(met.groupBy("key", "part", cell).agg(F.count(F.lit(1)).alias("n")), "quantile-cells")
    placed = positions(counted, [F.col("key"), F.col("part"), F.col("value").asc_nulls_first()])
    return running_before(placed, "position", ["key", "part"], "n", "before")


def exact_quantiles(df: DataFrame, keys: list[str], column: str, shares: dict[str, float],
                    accuracy: int = ACCURACY) -> DataFrame:
    """``keys`` and one column per name of ``shares``: the value at that share of the ranks, between two by distance.

    Null and NaN values are skipped; a group without values has no row. Null keys are a group.
    """
    names = list(shares)
    key = F.struct(*[F.col(f"`{c}`").alias(c) for c in keys]) if keys else F.struct(F.lit(0).alias("all"))
    value = F.col(f"`{column}`").cast("double")
    values = df.select(key.alias("key"), value.alias("value")).filter("value is not null and not isnan(value)")
    slack = 2 / accuracy
    asked = [max(p - slack, 0.0) for p in shares.values()] + [min(p + slack, 1.0) for p in shares.values()]
    sketch = values.groupBy("key").agg(
        F.count(F.lit(1)).alias("size"), F.percentile_approx("value", asked, accuracy).alias("marks"))
    edges = F.explode(F.array(*[F.struct(
        F.lit(i).alias("part"), F.lit(float(p)).alias("share"),
        (F.lit(-_INF) if p <= slack else F.get("marks", i)).alias("low"),
        (F.lit(_INF) if p >= 1 - slack else F.get("marks", i + len(names))).alias("high"))
        for i, p in enumerate(shares.values())])).alias("edge")
    wanted = materialise(sketch.select("key", "size", edges).select("key", "size", "edge.*"), "quantile-brackets")
    found, open_ = None, wanted
    while True:
        cells = _inside(values, open_.select("key", "part", "low", "high"))
        low, high = _ranks(F.col("share"), F.col("size"))
        near = cells.join(open_.select("key", "part", "share", "size"), ["key", "part"])

        def at(rank: Column) -> Column:
            return F.max(F.when((F.col("before") <= rank) & (rank < F.col("before") + F.col("n")), F.col("value")))

        read = near.groupBy("key", "part").agg(
            at(low).alias("a"), at(high).alias("b"), F.max(F.col("share") * (F.col("size") - 1) - low).alias("gap"))
        read = materialise(read, "quantiles")
        good = read.filter("a is not null and b is not null")
        found = good if found is None else found.unionByName(good)
        missed = open_.join(good.select("key", "part"), ["key", "part"], "left_anti").select(
            "key", "size", "part", "share", F.lit(-_INF).alias("low"), F.lit(_INF).alias("high"))
        open_ = materialise(missed, "quantile-brackets")
        if open_.isEmpty():
            break
    between = F.col("a") + (F.col("b") - F.col("a")) * F.col("gap")
    wide = found.groupBy("key").agg(*[F.max(F.when(F.col("part") == i, between)).alias(n) for i, n in enumerate(names)])
    return wide.select(*[F.col("key").getField(c).alias(c) for c in keys], *names)
