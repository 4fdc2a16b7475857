"""Column profiles: one aggregate pass over the table gives one small row per column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cobaltmill.functions import numbers as N
from cobaltmill.functions import vocab


def unpivot_metrics(one_row: DataFrame, cols: list[str], metrics: list[str]) -> DataFrame:
    """Turn one row of ``metric_i`` columns into one row per column."""
    rows = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), *[F.col(f"{m}_{i}").alias(m) for m in metrics])
        for i, c in enumerate(cols)
    ]))
    return one_row.select(rows.alias("r")).select("r.*")


def _share(condition: Column) -> Column:
    """Share of rows meeting the condition; nulls do not meet it."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


SHAPE_METRICS = ["filled", "pipe_density", "pipe_parts", "semicolon_density", "semicolon_parts"]


def shape_aggregates(cols: list[str]) -> list[Column]:
    """Per text column: filled rows, share of rows with each split mark, largest part count."""
    aggs = []
    for i, c in enumerate(cols):
        value = F.col(f"`{c}`")
        aggs.append(F.count(value).alias(f"filled_{i}"))
        for mark, name in zip(vocab.SPLIT_MARKS, ("pipe", "semicolon")):
            parts = F.length(value) - F.length(F.replace(value, F.lit(mark), F.lit(""))) + 1
            aggs.append(_share(value.contains(mark)).alias(f"{name}_density_{i}"))
            aggs.append(F.coalesce(F.max(parts), F.lit(0)).cast("long").alias(f"{name}_parts_{i}"))
    return aggs


def shape_profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row per column of :func:`shape_aggregates`."""
    return unpivot_metrics(df.agg(*shape_aggregates(cols)), cols, SHAPE_METRICS)


def delimiter_density(df: DataFrame, cols: list[str]) -> DataFrame:
    """Per column and mark: share of rows that contain it, and whether that calls for a split."""
    profile = shape_profile(df, cols)
    marks = F.explode(F.array(*[
        F.struct(F.lit(mark).alias("mark"), F.col(f"{name}_density").alias("density"))
        for mark, name in zip(vocab.SPLIT_MARKS, ("pipe", "semicolon"))
    ]))
    flat = profile.select("column", marks.alias("m")).select("column", "m.*")
    return flat.withColumn("dense", F.col("density") >= vocab.SPLIT_DENSITY)


def id_profile(df: DataFrame, cols: list[str], matching: str = "substring") -> DataFrame:
    """Per column: share of filled values that look like an id, and the verdict."""
    aggs = []
    for i, c in enumerate(cols):
        value = F.col(f"`{c}`").cast("string")
        aggs.append(
            F.coalesce(F.avg(F.when(value.isNotNull(), N.id_like(value).cast("double"))), F.lit(0.0))
            .alias(f"id_share_{i}")
        )
    shares = unpivot_metrics(df.agg(*aggs), cols, ["id_share"])
    named = [c for c in cols if name_hint(c, vocab.ID_HINTS, matching)]
    is_id = (F.col("id_share") >= vocab.ID_DENSITY) | F.col("column").isin(*named, "")
    return shares.withColumn("is_id", is_id)


def name_hint(name: str, hints: tuple[str, ...], matching: str = "substring") -> bool:
    """Does a column name carry one of the hints?

    ``substring`` accepts a hint anywhere in the name (so ``Costos`` counts as ``costo``);
    ``token`` compares whole words (so ``unit`` is not ``nit``).
    """
    lowered = name.lower()
    if matching == "substring":
        return any(h in lowered for h in hints)
    words = "".join(ch if ch.isalnum() or ch == "$" else " " for ch in lowered).split()
    return any(h in words for h in hints)


NUMERIC_TYPES = (T.NumericType,)


def is_numeric(field: T.StructField) -> bool:
    return isinstance(field.dataType, NUMERIC_TYPES)


def column_roles(df: DataFrame) -> DataFrame:
    """Role of every column for charting, with the exact number of distinct values of text columns.

    Categories have 2 to 50 values.
    """
    fields = df.schema.fields
    texts = [f.name for f in fields if not is_numeric(f)]
    counts = df.agg(
        F.lit(1).alias("one"),
        *[F.count_distinct(f"`{c}`").alias(f"d{i}") for i, c in enumerate(texts)],
    )
    rows = []
    for pos, f in enumerate(fields):
        distinct = F.col(f"d{texts.index(f.name)}") if f.name in texts else F.lit(None)
        numeric = F.lit(is_numeric(f))
        dated = F.lit(any(h in f.name.lower() for h in vocab.CHART_DATE_HINTS))
        rows.append(F.struct(
            F.lit(pos).cast("long").alias("pos"), F.lit(f.name).alias("column"),
            numeric.alias("is_numeric"), dated.alias("is_date"),
            distinct.cast("long").alias("n_distinct"),
            F.coalesce(distinct.between(2, 50), F.lit(False)).alias("is_categorical"),
        ))
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
