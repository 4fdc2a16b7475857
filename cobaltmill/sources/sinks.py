"""Sinks with read-back: records, sidecar metadata, chart specifications, report bundle, index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cobaltmill.sources.files import display_widths


def write_records(df: DataFrame, path: str, fmt: str) -> DataFrame:
    """Write ``df`` as csv, json or parquet and return the table read back."""
    writer = df.write.mode("errorifexists")
    if fmt == "csv":
        writer.option("header", "true").csv(path)
        return df.sparkSession.read.schema(df.schema).option("header", "true").csv(path)
    if fmt == "json":
        writer.json(path)
        return df.sparkSession.read.schema(df.schema).json(path)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_tenant(df: DataFrame, tenant: str) -> DataFrame:
    """Group rows for a write by tenant: few files per small tenant, large tenants stay split."""
    return df.hint("rebalance", tenant)


def write_sidecar(metadata: DataFrame, path: str, tenant: str) -> DataFrame:
    """Metadata records as JSON, one folder per tenant, read back with the same schema."""
    by_tenant(metadata, tenant).write.mode("errorifexists").partitionBy(tenant).json(path)
    return metadata.sparkSession.read.schema(metadata.schema).json(path)


def write_chart_specs(specs: DataFrame, path: str) -> DataFrame:
    """Chart specifications (one JSON text each) written and reloaded; invalid ones are dropped."""
    specs.select(F.col("spec").alias("value")).write.mode("errorifexists").text(path)
    return load_chart_specs(specs.sparkSession, path)


def load_chart_specs(spark: SparkSession, path: str) -> DataFrame:
    parsed = spark.read.text(path).select(F.try_parse_json("value").alias("spec"))
    kind = F.schema_of_variant("spec")
    return parsed.filter(kind.startswith("OBJECT") & (kind != "OBJECT<>"))


def append_index(vectors: DataFrame, path: str, tenant: str) -> DataFrame:
    """Append vectors to a tenant-partitioned index and return the whole index; never dedupes."""
    by_tenant(vectors, tenant).write.mode("append").partitionBy(tenant).parquet(path)
    return vectors.sparkSession.read.schema(vectors.schema).parquet(path)


def write_report(df: DataFrame, path: str, summary: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The data sheet and a row per column (filled cells, display width), both as written tables.

    ``summary`` (one text column) is written next to them.
    """
    data = write_records(df, f"{path}/data", "parquet")
    if summary is not None:
        summary.write.mode("errorifexists").text(f"{path}/summary")
    widths = write_records(display_widths(data), f"{path}/widths", "parquet")
    return data, widths
