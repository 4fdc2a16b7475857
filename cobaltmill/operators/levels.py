"""Aggregates on several grouping levels at once, and pivoted tables.

The rows are aggregated once, on all keys; the coarser levels come from those groups, so only groups are
copied per level. Aggregates that can't be built from parts (distinct counts) are computed from the
rows by Spark's own grouping sets instead. ``level`` is the grouping id: bit by bit, from the first key as the highest, 1
for a key that is summed over. So a key that is null in the data differs from a subtotal.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cobaltmill.operators.aggregates import aggregate
from cobaltmill.session import materialise

_PARTS = ("count", "sum", "mean", "max", "min")


def grouping_sets(keys: list[str], sets: str | list[list[str]]) -> list[list[str]]:
    """The levels of ``rollup`` or ``cube``, or those that are listed."""
    if sets == "rollup":
        return [keys[:n] for n in range(len(keys), -1, -1)]
    if sets == "cube":
        return [list(c) for n in range(len(keys), -1, -1) for c in itertools.combinations(keys, n)]
    if isinstance(sets, str):
        raise ValueError("subtotals are 'rollup', 'cube' or a list of lists of keys")
    unknown = {c for s in sets for c in s} - set(keys)
    if unknown:
        raise ValueError(f"subtotals by {', '.join(sorted(unknown))}, which is no key")
    return sets


def _named(c: str) -> Column:
    return F.col(f"`{c}`")


def _merged(metric: dict) -> Column:
    name = metric["name"]
    if metric["agg"] == "mean":
        return F.try_divide(F.sum(f"__sum_{name}"), F.sum(f"__n_{name}")).alias(name)
    how = {"count": F.sum, "sum": F.sum, "max": F.max, "min": F.min}[metric["agg"]]
    return (F.coalesce(how(f"__{name}"), F.lit(0)) if metric["agg"] in ("count", "sum") else how(f"__{name}")).alias(name)


def _parts(metric: dict) -> list[Column]:
    value = _named(metric["column"]) if metric.get("column") else None
    if metric["agg"] == "mean":
        return [F.sum(value).alias(f"__sum_{metric['name']}"), F.count(value).alias(f"__n_{metric['name']}")]
    return [aggregate(value, metric["agg"]).alias(f"__{metric['name']}")]


def grouped_levels(df: DataFrame, keys: list[str], metrics: list[dict], sets: str | list[list[str]]) -> DataFrame:
    """``keys, level, metrics...`` for every level; null keys are groups of their own."""
    levels = [[_named(c) for c in s] for s in grouping_sets(keys, sets)]
    every = [_named(c) for c in keys]
    level = F.grouping_id(*every).cast("int").alias("level")
    if all(m["agg"] in _PARTS for m in metrics):
        base = df.groupBy(*every).agg(*[p for m in metrics for p in _parts(m)])
        found = base.groupingSets(levels, *every).agg(level, *[_merged(m) for m in metrics])
    else:
        found = df.groupingSets(levels, *every).agg(level, *[
            aggregate(_named(m["column"]) if m.get("column") else None, m["agg"]).alias(m["name"]) for m in metrics])
    return found.select(*every, "level", *[_named(m["name"]) for m in metrics])


def pivoted(df: DataFrame, keys: list[str], column: str, metric: dict, values: list | None = None) -> DataFrame:
    """One row per key, one column per value of ``column``; nulls are a column ``null``, missing cells are null.

    Without ``values`` the columns are found in the data, at most ``spark.sql.pivotMaxValues`` of them.
    """
    base = df.groupBy(*[_named(c) for c in [*keys, column]]).agg(*_parts(metric))
    base = materialise(base, "pivot")
    wide = base.groupBy(*[_named(c) for c in keys])
    merged = _merged(metric)
    return (wide.pivot(column, values) if values else wide.pivot(column)).agg(merged)
