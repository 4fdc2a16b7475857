"""Grouped aggregates with the null rules of the data model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cobaltmill.functions import numbers as N
from cobaltmill.functions import vocab
from cobaltmill.operators.ordering import first_n
from cobaltmill.operators.profile import is_numeric

AGGREGATES = ("count", "sum", "mean", "max", "min", "distinct", "median")


def aggregate(value: Column | None, agg: str) -> Column:
    """One aggregate: nulls are skipped and an all-null group sums to 0."""
    if agg == "count":
        return F.count(F.lit(1))
    if value is None or agg not in AGGREGATES:
        raise ValueError(f"aggregate must be one of {', '.join(AGGREGATES)}; all but count need a value")
    if agg == "sum":
        return F.coalesce(F.sum(value), F.lit(0))
    return {"mean": F.avg, "max": F.max, "min": F.min, "distinct": F.count_distinct, "median": F.median}[agg](value)


def group_by(df: DataFrame, key: str, agg: str = "count", value: str | None = None,
             name: str = "value") -> DataFrame:
    """Aggregate per key; rows without a key are left out. Who shows the rows orders them."""
    col = F.col(value) if value else None
    grouped = df.filter(F.col(key).isNotNull()).groupBy(key)
    return grouped.agg(aggregate(col, agg).alias(name))


def conditional_pct(df: DataFrame, keys: list[str], counted: str | Column, condition: Column,
                    count_name: str, pct_name: str) -> DataFrame:
    """Per group the filled count and the percentage of rows that meet a condition."""
    hit = F.when(condition, 1.0).otherwise(0.0)
    return df.groupBy(*keys).agg(
        F.count(counted).alias(count_name), (100 * F.avg(hit)).alias(pct_name)
    )


def quantity_column(df: DataFrame) -> str:
    """First column whose name hints at a quantity, else the last numeric, else the last one."""
    for c in df.columns:
        if any(h in c.lower() for h in vocab.QUANTITY_HINTS):
            return c
    numeric = [f.name for f in df.schema.fields if is_numeric(f)]
    return (numeric or df.columns)[-1]


def demand_summary(df: DataFrame) -> DataFrame:
    """Rows, total and mean per row of the quantity column; text and nulls count as 0."""
    c = quantity_column(df)
    numeric = dict(df.dtypes)[c] != "string"
    value = F.col(c).cast("double") if numeric else N.to_number(F.col(c))
    amount = F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0))
    totals = df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(amount), F.lit(0.0)).alias("total"))
    return totals.select(
        F.lit(c).alias("quantity_column"), "n_rows", "total",
        (F.col("total") / F.greatest("n_rows", F.lit(1))).alias("mean_per_row"),
    )


def latest_n(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The newest ``n`` rows per key, ranked newest first."""
    return first_n(df, keys, [F.col(c).desc() for c in order], n)


def oldest_first(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The newest ``n`` rows per key, numbered oldest first."""
    newest = latest_n(df, keys, order, n)
    kept = F.max("rank").over(W.partitionBy(*keys))  # over at most n rows of a key
    return newest.withColumn("position", kept - F.col("rank") + 1).drop("rank")


def chart_policy(artifacts: DataFrame, keys: list[str], path: str, position: Column,
                 n_types: int | None = None) -> DataFrame:
    """First appearance of each path in order, up to the number of allowed chart types (1 to 6)."""
    limit = 4 if not n_types else max(1, min(6, n_types))
    present = artifacts.withColumn(path, F.trim(path)).filter(F.col(path) != "")
    firsts = present.groupBy(*keys, path).agg(F.min(position).alias("__pos"))
    return first_n(firsts, keys, [F.col("__pos")], limit).drop("__pos")


def compliance_evidence(df: DataFrame, keys: list[str], tariff: Column, origin: Column,
                        fob: Column, cif: Column) -> DataFrame:
    """Which evidence a declaration table holds; rules without evidence say so."""
    def state(hits: Column) -> Column:
        return F.when(hits > 0, "ok").otherwise(vocab.MISSING_EVIDENCE)

    counts = df.groupBy(*keys).agg(
        F.count_if(tariff.rlike(r"^\d{10}$")).alias("n_tariff"),
        F.count_if(F.trim(origin) != "").alias("n_origin"),
        F.count_if(fob.isNotNull() & cif.isNotNull()).alias("n_values"),
        F.count_if(cif < fob).alias("n_cif_below_fob"),
    )
    return counts.withColumns({
        "tariff_state": state(F.col("n_tariff")),
        "origin_state": state(F.col("n_origin")),
        "value_state": F.when(F.col("n_values") == 0, vocab.MISSING_EVIDENCE)
        .when(F.col("n_cif_below_fob") > 0, "cif_below_fob").otherwise("ok"),
    })
