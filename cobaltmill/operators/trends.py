"""Ranks, running sums, moving means, changes and shares within groups of any size.

The rows are range-sorted once by group and order and numbered. A number's high bits name a block, so a window
works inside one block of a group; what a block passes on is carried by a table of blocks (running sums
and ranks), or by the block's last rows, copied to the next block (moving means and changes). No window
ever holds a whole group or a whole table, however many rows have one key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cobaltmill.operators.ordering import BLOCK_BITS, locf, positions, running_before
from cobaltmill.session import materialise

KINDS = ("row_number", "rank", "dense_rank", "running_sum", "moving_mean", "change", "change_pct", "share")
_KEY, _POS, _FIRST = "__key", "__pos", "__first"
_UNSORTED = ("map", "variant", "interval")


def named(c: str) -> Column:
    return F.col(f"`{c}`")


def look_back(df: DataFrame, rows: int, found: dict[str, Column], bits: int) -> DataFrame:
    """Add window values that reach at most ``rows`` rows back; ``found`` holds columns over ``earlier``.

    The last rows of each block are copied to the next one, where they are only looked at.
    """
    size = 1 << bits
    if rows >= size:
        raise ValueError(f"a window reaches over at most {size - 1} earlier rows")
    block = F.shiftright(_POS, bits)
    late = F.pmod(F.col(_POS), F.lit(size)) >= size - rows
    both = F.explode(F.array_compact(F.array(block, F.when(late, block + 1))))
    spread = df.withColumn("__block", both)
    return spread.withColumns(found).filter(F.col("__block") == block).drop("__block")


def earlier(rows: int) -> W:
    """The row and the ``rows`` before it, within its group and block."""
    return W.partitionBy(_KEY, "__block").orderBy(_POS).rowsBetween(-rows, 0)


def add_trends(df: DataFrame, by: list[str], order: list[tuple[str, bool]], measures: list[dict],
               bits: int = BLOCK_BITS) -> DataFrame:
    """Add the columns that ``measures`` name, within the groups of ``by`` and in ``order`` (column, descending).

    A measure has a ``name``, a ``kind`` of ``KINDS``, a ``column`` but for numbers and ranks, and ``n`` rows for a
    moving mean. Null keys are a group; ties in the order go by the other columns, ascending. In a running
    sum a null counts 0; a moving mean skips nulls; a change is to the row before, null for the first
    one; a share is of the group's sum.
    """
    for m in measures:
        if m["kind"] not in KINDS:
            raise ValueError(f"a trend is one of {', '.join(KINDS)}")
        if m["kind"] in ("running_sum", "moving_mean", "change", "change_pct", "share") and not m.get("column"):
            raise ValueError(f"{m['kind']} needs a column")
    columns = df.columns
    kinds = {m["kind"] for m in measures}
    fixed = {c for c, _ in order} | set(by)
    rest = [c for c, t in df.dtypes if c not in fixed and not t.startswith(_UNSORTED)]
    keyed = df.withColumn(_KEY, F.struct(*[named(c) for c in by]) if by else F.struct(F.lit(0).alias("all")))
    sort = [named(c).desc() if descending else named(c).asc() for c, descending in order]
    rows = positions(keyed, [F.col(_KEY), *sort, *[named(c) for c in rest]], _POS)

    summed = list(dict.fromkeys(m["column"] for m in measures if m["kind"] == "share"))
    starts = rows.groupBy(_KEY).agg(F.min(_POS).alias(_FIRST), *[
        F.sum(named(c)).alias(f"__sum{i}") for i, c in enumerate(summed)])
    rows = rows.join(materialise(starts, "trend-groups"), _KEY)
    added = {}
    for m in measures:
        if m["kind"] == "row_number":
            added[m["name"]] = F.col(_POS) - F.col(_FIRST) + 1
        if m["kind"] == "share":
            added[m["name"]] = F.try_divide(named(m["column"]).cast("double"), F.col(f"__sum{summed.index(m['column'])}").cast("double"))

    back, reach = {}, 0
    if kinds & {"rank", "dense_rank"}:
        tie = F.struct(*[named(c) for c, _ in order])
        before = F.lag(tie).over(W.partitionBy(_KEY, "__block").orderBy(_POS))
        back["__new"] = (F.col(_POS) == F.col(_FIRST)) | ~before.eqNullSafe(tie)
        reach = 1
    for m in measures:
        n = int(m.get("n", 1)) - 1 if m["kind"] == "moving_mean" else 1
        if m["kind"] == "moving_mean":
            back[m["name"]] = F.avg(named(m["column"])).over(earlier(n))
        elif m["kind"] in ("change", "change_pct"):
            value = named(m["column"])
            before = F.lag(value).over(W.partitionBy(_KEY, "__block").orderBy(_POS))
            moved = value - before
            back[m["name"]] = moved if m["kind"] == "change" else F.try_divide(
                moved.cast("double"), before.cast("double")) * 100
        else:
            continue
        reach = max(reach, n)
    if back:
        rows = look_back(rows, reach, back, bits)
    for m in measures:
        if m["kind"] == "running_sum":
            value = F.coalesce(named(m["column"]), F.lit(0).cast(dict(df.dtypes)[m["column"]]))
            rows = running_before(rows.withColumn("__value", value), _POS, [_KEY], "__value", "__before", bits)
            rows = rows.withColumn(m["name"], F.col("__before") + F.col("__value")).drop("__before", "__value")
        elif m["kind"] == "dense_rank":
            rows = rows.withColumn("__value", F.col("__new").cast("long"))
            rows = running_before(rows, _POS, [_KEY], "__value", "__before", bits)
            rows = rows.withColumn(m["name"], F.col("__before") + F.col("__value")).drop("__before", "__value")
        elif m["kind"] == "rank":
            rows = rows.withColumn(m["name"], F.when(F.col("__new"), F.col(_POS) - F.col(_FIRST) + 1))
            rows = locf(rows, _POS, [m["name"]], [_KEY], bits)
    rows = rows.withColumns(added) if added else rows
    return rows.select(*[named(c) for c in columns], *[named(m["name"]) for m in measures])
