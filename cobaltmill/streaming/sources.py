"""Streams over folders of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cobaltmill.session import table


def table_stream(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """A stored table as a stream with the table's own schema."""
    reader = spark.readStream.schema(table(spark, sf_dir, name).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def json_log_stream(spark: SparkSession, path: str) -> DataFrame:
    """Raw JSON bodies, one per line, as they arrive."""
    return spark.readStream.text(path).select(F.col("value").alias("body"))
