"""Sessions: runs of one user's messages without a long pause."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

GAP = dt.timedelta(minutes=30)


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds of a time; of a time without a zone by its fields, so that no zone's clock change counts."""
    c = F.col(name)
    if not isinstance(df.schema[name].dataType, T.TimestampNTZType):
        return F.unix_micros(c)
    minutes = (F.unix_date(F.to_date(c)).cast("long") * 24 + F.hour(c)) * 60 + F.minute(c)
    return minutes * 60_000_000 + (F.date_part(F.lit("SECOND"), c) * 1_000_000).cast("long")


def sessions(messages: DataFrame, gap: dt.timedelta = GAP) -> DataFrame:
    """``user_id, session_start, session_end, n_messages`` from messages (user_id, ts).

    A pause of more than ``gap`` ends a session. Messages of one user in one stretch of ``gap`` length
    always share a session, so they are first combined by an aggregate; only these stretches, at most
    one per ``gap`` of time and user, are put in order. A busy user costs no more than a quiet one there.

    Messages without a time are in no session; those without a user are one user's.
    """
    step = gap // dt.timedelta(microseconds=1)
    timed = messages.filter(F.col("ts").isNotNull())
    stretch = F.floor(micros(messages, "ts") / F.lit(step)).alias("stretch")
    parts = timed.groupBy("user_id", stretch).agg(
        F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("user_id").orderBy("stretch")
    pause = F.col("first") - F.lag("last").over(order)
    opened = parts.withColumn("opens", F.coalesce(pause > F.lit(gap), F.lit(True)).cast("long"))
    numbered = opened.withColumn("number", F.sum("opens").over(order))
    return numbered.groupBy("user_id", "number").agg(
        F.min("first").alias("session_start"), F.max("last").alias("session_end"),
        F.sum("n").alias("n_messages")).drop("number")
