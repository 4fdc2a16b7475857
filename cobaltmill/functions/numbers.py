"""Number, identifier and date parsing for dirty text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cobaltmill.functions.text import norm_text

_FLOAT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"

# Accepted shapes and the layout of each, day first; the first shape that fits decides.
_DAY, _ISO, _TIME = r"\d{1,2}", r"\d{4}-\d{1,2}-\d{1,2}", r"\d{1,2}:\d{1,2}:\d{1,2}"
_MONTH = r"[A-Za-z]{3,9}\.?"
DATE_LAYOUTS = (
    (rf"{_DAY}/{_DAY}/\d{{4}}", "d/M/yyyy"), (rf"{_DAY}-{_DAY}-\d{{4}}", "d-M-yyyy"),
    (rf"{_DAY}\.{_DAY}\.\d{{4}}", "d.M.yyyy"), (_ISO, "yyyy-M-d"), (r"\d{4}/\d{1,2}/\d{1,2}", "yyyy/M/d"),
    (rf"{_DAY}/{_DAY}/\d{{4}} {_TIME}", "d/M/yyyy H:m:s"), (rf"{_ISO} {_TIME}", "yyyy-M-d H:m:s"),
    (rf"{_ISO}T{_TIME}", "yyyy-M-d'T'H:m:s"), (rf"{_DAY}/{_DAY}/\d{{4}} {_DAY}:{_DAY}", "d/M/yyyy H:m"),
    (rf"{_ISO} {_DAY}:{_DAY}", "yyyy-M-d H:m"), (rf"{_ISO}T{_TIME}\.\d{{1,6}}", "yyyy-M-d'T'H:m:s.SSSSSS"),
    (rf"{_ISO} {_TIME}\.\d{{1,6}}", "yyyy-M-d H:m:s.SSSSSS"),
    (rf"{_ISO}T{_TIME}(Z|[+-]\d\d:\d\d)", "yyyy-M-d'T'H:m:sXXX"),
    (rf"{_ISO}T{_TIME}\.\d{{1,6}}(Z|[+-]\d\d:\d\d)", "yyyy-M-d'T'H:m:s.SSSSSSXXX"),
    (rf"{_DAY}/{_DAY}/\d\d", "d/M/yy"), (rf"{_DAY}-{_DAY}-\d\d", "d-M-yy"), (rf"{_DAY}\.{_DAY}\.\d\d", "d.M.yy"),
    (r"\d{8}", "yyyyMMdd"), (rf"{_MONTH} {_DAY},? \d{{4}}", "MMM d yyyy"), (rf"{_DAY}[ -]{_MONTH}[ -]\d{{4}}", "d MMM yyyy"),
)
#: Two-digit years from here on lie in the last century.
LAST_CENTURY = 70


def to_number(c: Column) -> Column:
    """Plain decimal text to double; anything else to null."""
    text = F.trim(c.cast("string"))
    return F.when(text.rlike(_FLOAT), text.try_cast("double"))


def _count(c: Column, mark: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(mark), F.lit("")))


def _drop(c: Column, mark: str) -> Column:
    return F.replace(c, F.lit(mark), F.lit(""))


def _money_chars(c: Column) -> Column:
    return F.regexp_replace(norm_text(c.cast("string")), r"[^0-9,.\-]", "")


def parse_cop(c: Column) -> Column:
    """Peso amounts: dots group thousands and a comma is the decimal mark, with the usual mixes."""
    s = _money_chars(c)
    dots, commas = _count(s, "."), _count(s, ",")
    comma_decimal = F.replace(_drop(s, "."), F.lit(","), F.lit("."))
    text = (
        F.when((dots > 1) | ((dots == 1) & (commas >= 1)), comma_decimal)
        .when((dots == 1) & s.rlike(r"^-?\d+\.\d{3}$"), _drop(s, "."))
        .when((dots == 0) & (commas == 1), F.replace(s, F.lit(","), F.lit(".")))
        .when((dots == 0) & (commas > 1), _drop(s, ","))
        .otherwise(s)
    )
    return to_number(text)


def parse_usd(c: Column) -> Column:
    """Dollar amounts: commas group thousands."""
    return to_number(_drop(_money_chars(c), ","))


def id_compact(c: Column) -> Column:
    return F.regexp_replace(norm_text(c), r"[.,\s]", "")


def id_like(c: Column) -> Column:
    """Looks like a tax or identity number: 8 to 10 digits and an optional check part."""
    return id_compact(c).rlike(r"^\d{8,10}(-\w+)?$")


def id_normalize(c: Column) -> Column:
    """Drop separators and the check part; keep the first 8 to 10 digit run, else the rest."""
    text = F.regexp_replace(F.translate(norm_text(c), "., ", ""), r"-\w+$", "")
    run = F.regexp_extract(text, r"(\d{8,10})", 1)
    return F.when(run != "", run).otherwise(text)


def parse_date(c: Column) -> Column:
    """Day-first date text to a zone-less timestamp; bad text to null.

    The shape of the text picks the layout, so at most one parse is tried per value. A text with an
    offset gives its time in the session's zone; English month names may be cut to three letters.
    """
    text = F.trim(c)
    month = F.regexp_replace(F.regexp_replace(text, r"[,.]", ""), "-", " ")
    month = F.regexp_replace(month, r"([A-Za-z]{3})[A-Za-z]*", "$1")
    out = F.when(F.lit(False), F.lit(None).cast("timestamp"))
    for shape, layout in DATE_LAYOUTS:
        parsed = F.try_to_timestamp(month if "MMM" in layout else text, F.lit(layout))
        if layout.endswith("yy") and not layout.endswith("yyyy"):
            old = F.substring(text, -2, 2).try_cast("int") >= LAST_CENTURY
            parsed = F.when(old, parsed - F.expr("INTERVAL 100 YEARS")).otherwise(parsed)
        out = out.when(text.rlike(f"^{shape}$"), parsed)
    return out.cast("timestamp_ntz")


def value_coerce(c: Column) -> Column:
    """Chart value: null, text and NaN become 0; others are kept to four places."""
    number = (F.col(c) if isinstance(c, str) else c).try_cast("double")
    return F.round(F.coalesce(F.nanvl(number, F.lit(0.0)), F.lit(0.0)), 4)


def text_value_coerce(c: Column) -> Column:
    return value_coerce(to_number(c))


def label_coerce(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))
