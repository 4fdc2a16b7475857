"""Local-day arithmetic on zone-less UTC timestamps, independent of the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cobaltmill.functions.vocab import QUOTA_ZONE


def local_time(ts: Column, zone: str = QUOTA_ZONE) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts.cast("timestamp_ntz"))


def local_day(ts: Column, zone: str = QUOTA_ZONE) -> Column:
    return F.to_date(local_time(ts, zone))


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970 as a decimal, whatever the session time zone."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    span = (ts.cast("timestamp_ntz") - epoch).cast("interval second")
    return span.cast("decimal(20,6)")


def next_reset(ts: Column, zone: str = QUOTA_ZONE) -> Column:
    """The UTC instant at which the next local day begins."""
    midnight = F.date_add(local_day(ts, zone), 1).cast("timestamp_ntz")
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), midnight)


def same_local_day(a: Column, b: Column, zone: str = QUOTA_ZONE) -> Column:
    return local_day(a, zone) == local_day(b, zone)
