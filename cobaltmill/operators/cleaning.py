"""Column-level cleaning steps for all-string tables (the pipeline is in plans.clean)."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cobaltmill.functions import numbers as N
from cobaltmill.functions import text as T
from cobaltmill.functions import vocab
from cobaltmill.operators.ordering import locf
from cobaltmill.operators.profile import name_hint, shape_profile, unpivot_metrics
from cobaltmill.session import computed_once


def normalise_cells(df: DataFrame, cols: list[str]) -> DataFrame:
    """Normalise white space, turn blanks into nulls and drop rows without any value."""
    cells = F.struct(*[F.nullif(T.norm_text(F.col(f"`{c}`")), F.lit("")).alias(c) for c in cols])
    rest = [c for c in df.columns if c not in cols]
    clean = computed_once(df, cells, "__cells").select(
        *rest, *[F.col("__cells").getField(c).alias(c) for c in cols]
    )
    return clean.filter(reduce(or_, [F.col(f"`{c}`").isNotNull() for c in cols]))


def split_names(name: str, mark: str, parts: int, taken: set[str]) -> list[str]:
    """Names for the parts of a split column: the header's own parts when they agree in number
    and are free, which ``taken`` then records."""
    pieces = [p.strip() for p in name.split(mark)]
    fits = len(pieces) == parts and all(pieces) and len(set(pieces)) == parts
    if not fits or taken & set(pieces):
        pieces = [f"{name}_p{i}" for i in range(parts)]
    taken |= set(pieces)
    return pieces


def shape(df: DataFrame, cols: list[str]) -> DataFrame:
    """Drop columns without values and split merged ones, both decided by one profile pass.

    A column is split on ``|`` (or else ``;``) when 60 % of the rows hold that mark.
    """
    rows = shape_profile(df, cols).collect()  # one row per column
    return reshape(df, *shape_plan([r.asDict() for r in rows]))


def shape_plan(profile: list[dict]) -> tuple[set[str], dict[str, tuple[str, int]]]:
    """Columns without values, and mark and number of parts of the columns to split."""
    blank, plan = set(), {}
    for row in profile:
        if not row["filled"]:
            blank.add(row["column"])
            continue
        for mark, name in zip(vocab.SPLIT_MARKS, ("pipe", "semicolon")):
            if row[f"{name}_density"] >= vocab.SPLIT_DENSITY:
                plan[row["column"]] = (mark, row[f"{name}_parts"])
                break
    return blank, plan


def reshape(df: DataFrame, blank: set[str], plan: dict[str, tuple[str, int]]) -> DataFrame:
    out: list[Column] = []
    taken = {c for c in df.columns if c not in plan}
    for c in df.columns:
        if c in plan:
            mark, parts = plan[c]
            pieces = F.split(F.col(f"`{c}`"), "\\" + mark)
            for i, name in enumerate(split_names(c, mark, parts, taken)):
                out.append(F.trim(F.get(pieces, F.lit(i))).alias(name))
        elif c not in blank:
            out.append(F.col(f"`{c}`"))
    return df.select(*out)


def typed_value(c: Column, name: str, is_id: bool, matching: str = "substring") -> Column:
    """A column's value under the naming rules: ids first, then dollars, then pesos."""
    if is_id:
        return N.id_normalize(c)
    if name_hint(name, vocab.USD_HINTS, matching):
        return N.parse_usd(c)
    if name_hint(name, vocab.COP_HINTS, matching):
        return N.parse_cop(c)
    return c


def type_by_name(df: DataFrame, cols: list[str], id_cols: set[str],
                 matching: str = "substring") -> DataFrame:
    """Apply :func:`typed_value` to every column in one projection."""
    return df.select(*[
        typed_value(F.col(f"`{c}`"), c, c in id_cols, matching).alias(c)
        if c in cols else F.col(f"`{c}`")
        for c in df.columns
    ])


def parse_rate(value: Column) -> Column:
    """Share of all rows (nulls included) whose value is a number."""
    return F.avg(F.when(N.to_number(value).isNotNull(), 1.0).otherwise(0.0))


def quarantine_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """Turn critical columns into numbers when at least 35 % of their rows parse."""
    rates = df.agg(*[parse_rate(F.col(f"`{c}`")) for c in cols]).first()
    passing = {c for c, rate in zip(cols, rates) if rate is not None and rate >= vocab.NUMERIC_PARSE_RATE}
    return df.select(*[
        N.to_number(F.col(f"`{c}`")).alias(c) if c in passing else F.col(f"`{c}`")
        for c in df.columns
    ])


def impute_additive(df: DataFrame, cols: list[str]) -> DataFrame:
    """Missing charges count as zero."""
    return df.withColumns({c: F.coalesce(F.col(f"`{c}`"), F.lit(0.0)) for c in cols})


def impute_forward(df: DataFrame, order: str, cols: list[str],
                   keys: list[str] | None = None) -> DataFrame:
    """Other critical numbers: last known value, then zero."""
    return impute_additive(locf(df, order, cols, keys), cols)


def date_failures(df: DataFrame, cols: list[str]) -> DataFrame:
    """Per date column the filled cells and those among them that no layout fits."""
    aggs = []
    for i, c in enumerate(cols):
        value = F.nullif(F.trim(F.col(f"`{c}`")), F.lit(""))
        aggs += [F.count(value).alias(f"filled_{i}"),
                 F.count_if(value.isNotNull() & N.parse_date(value).isNull()).alias(f"failed_{i}")]
    return unpivot_metrics(df.agg(*aggs), cols, ["filled", "failed"])


def coerce_dates(df: DataFrame, order: str, cols: list[str]) -> DataFrame:
    """Day-first dates; bad text takes the last good date."""
    parsed = df.withColumns({c: N.parse_date(F.col(f"`{c}`")) for c in cols})
    return locf(parsed, order, cols)
