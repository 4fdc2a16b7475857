"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word is a run of bytes other than space and the ASCII controls 9 to 13.
WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a whole text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def text_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """``df`` for workers that take whole texts: Arrow batches of 1000 rows instead of Spark's 10,000.

    A batch is held by the executor and by its worker at once, and texts are wide. A session that has
    another setting keeps it.
    """
    spark = df.sparkSession
    if spark.conf.get(_BATCH_ROWS) == "10000":
        spark.conf.set(_BATCH_ROWS, str(rows))
    return df


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as make it differ from all columns of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
