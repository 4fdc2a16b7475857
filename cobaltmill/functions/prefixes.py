"""Issuer prefixes: at most 8 characters. Of longer inputs the reader keeps only that they are overlong."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: ranges of the leading six digits (first match wins) and first digits ---------
COUNTRY_RANGES = (("US", 400000, 499999), ("BR", 500000, 509999), ("MX", 450000, 459999))
BRANDS = (("4", "VISA"), ("5", "MASTERCARD"), ("3", "AMEX"))
PREFIX_FORMAT = r"^\d{6,8}$"
# ------------------------------------------------------------------------------------------------


PREFIX_CHARS = 8


def is_overlong(c: Column) -> Column:
    return F.coalesce(F.length(F.trim(c.cast("string"))) > PREFIX_CHARS, F.lit(False))


def read_prefix(c: Column) -> Column:
    """The trimmed prefix; null for an overlong input, of which nothing may be kept."""
    return F.when(~is_overlong(c), F.trim(c.cast("string")))


def format_ok(prefix: Column) -> Column:
    return F.coalesce(prefix.rlike(PREFIX_FORMAT), F.lit(False))


def checksum_ok(prefix: Column) -> Column:
    """Mod-10 with the rightmost digit doubled, which is the usual check of the prefix plus 0."""
    return format_ok(prefix) & F.call_function("luhn_check", F.concat(prefix, F.lit("0")))


def level(prefix: Column) -> Column:
    return (
        F.when(~format_ok(prefix), "LOW").when(checksum_ok(prefix), "HIGH").otherwise("MEDIUM")
    )


def country(prefix: Column, ranges: tuple = COUNTRY_RANGES) -> Column:
    lead = F.substring(prefix, 1, 6).try_cast("int")
    out = F.when(F.lit(False), "")
    for name, low, high in ranges:
        out = out.when(lead.between(low, high), name)
    return out.otherwise("UNKNOWN")


def brand(prefix: Column) -> Column:
    out = F.when(F.lit(False), "")
    for digit, name in BRANDS:
        out = out.when(prefix.startswith(digit), name)
    return out.otherwise("UNKNOWN")
