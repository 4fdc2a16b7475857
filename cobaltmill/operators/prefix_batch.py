"""Batch classification of issuer prefixes per store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cobaltmill.functions import prefixes as P
from cobaltmill.operators.aggregates import conditional_pct


def normalise(rows: DataFrame, prefix: str = "prefix") -> DataFrame:
    """Trimmed prefixes and the flag ``overlong``; exact duplicate rows dropped.

    An overlong input becomes a null prefix. Such rows may stem from different inputs, which must not
    be compared, so all of them stay.
    """
    read = rows.withColumn("overlong", P.is_overlong(F.col(prefix))).withColumn(
        prefix, P.read_prefix(F.col(prefix)))
    return read.filter(~F.col("overlong")).dropDuplicates().unionByName(read.filter("overlong"))


def classify(rows: DataFrame, prefix: str = "prefix") -> DataFrame:
    """Country, brand and validation level next to the input columns (the store stays)."""
    c = F.col(prefix)
    return rows.withColumns({
        "country": P.country(c), "card_type": P.brand(c), "validation_level": P.level(c),
    })


def store_summary(classified: DataFrame, prefix: str = "prefix") -> DataFrame:
    """Inputs and percentage of HIGH per store, country and brand; overlong inputs count as LOW."""
    return conditional_pct(
        classified, ["store_id", "country", "card_type"],
        F.when(F.col(prefix).isNotNull() | F.col("overlong"), F.lit(1)),
        F.col("validation_level") == "HIGH", "prefix_count", "high_validation_percent",
    )
