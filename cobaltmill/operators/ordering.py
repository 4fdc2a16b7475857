"""Order-dependent operators that never sort a whole group in one task.

Rows are cut into blocks of 2**20 consecutive row ids. A window works inside one block only; what
a block passes on is carried by a table with one row per block, which is cut into blocks the same
way. After two levels at most 2**23 rows are left for any 63-bit id, so every window is bounded
whatever the size of the source or of a single group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cobaltmill.session import materialise

BLOCK_BITS = 20
LEVELS = 2
KEY_PARTS = 64


def _last_known(name: str, order: str) -> Column:
    """Last non-null value by ``order``, as an aggregate that combines map-side."""
    return F.max_by(name, F.when(F.col(name).isNotNull(), F.col(order))).alias(name)


def _attach(df: DataFrame, carry: DataFrame, on: list[str], cols: list[str]) -> DataFrame:
    renamed = carry.select(*on, *[F.col(c).alias(f"__carry_{c}") for c in cols])
    return df.join(renamed, on, "left")


def _earlier_last(df: DataFrame, keys: list[str], order: str, cols: list[str], bits: int,
                  levels: int) -> DataFrame:
    """Replace ``cols`` by their last known value strictly before each row."""
    rest = [c for c in df.columns if c not in cols]
    if levels == 0:
        window = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
        return df.select(*rest, *[F.last(c, True).over(window).alias(c) for c in cols])
    block = f"__block{levels}"
    on = [*keys, block]
    blocked = df.withColumn(block, F.shiftright(order, bits))
    ends = blocked.groupBy(*on).agg(*[_last_known(c, order) for c in cols])
    carry = _earlier_last(ends, keys, block, cols, bits, levels - 1)
    window = W.partitionBy(*on).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    joined = _attach(blocked, carry, on, cols)
    return joined.select(
        *rest,
        *[F.coalesce(F.last(c, True).over(window), f"__carry_{c}").alias(c) for c in cols],
    )


def locf(df: DataFrame, order: str, cols: list[str], keys: list[str] | None = None,
         bits: int = BLOCK_BITS, levels: int = LEVELS) -> DataFrame:
    """Last observation carried forward in ``order`` (a unique non-negative id) within ``keys``."""
    keys = keys or []
    on = [*keys, "__block"]
    blocked = df.withColumn("__block", F.shiftright(order, bits))
    ends = blocked.groupBy(*on).agg(*[_last_known(c, order) for c in cols])
    carry = _earlier_last(ends, keys, "__block", cols, bits, levels - 1)
    window = W.partitionBy(*on).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    joined = _attach(blocked, carry, on, cols)
    filled = {c: F.coalesce(F.last(c, True).over(window), f"__carry_{c}") for c in cols}
    return joined.select(*[filled[c].alias(c) if c in filled else c for c in df.columns])


def occurrence_number(df: DataFrame, order: str, keys: list[str], name: str,
                      bits: int = BLOCK_BITS, levels: int = LEVELS) -> DataFrame:
    """Row number within ``keys`` by ``order``; a key may hold any number of rows."""
    on = [*keys, "__block"]
    blocked = df.withColumn("__block", F.shiftright(order, bits))
    sizes = blocked.groupBy(*on).agg(F.count(F.lit(1)).alias("__n"))
    offsets = _earlier_sum(sizes, keys, "__block", bits, levels - 1)
    local = F.row_number().over(W.partitionBy(*on).orderBy(order))
    return (
        blocked.join(offsets.withColumnRenamed("__n", "__before"), on, "left")
        .withColumn(name, local + F.coalesce("__before", F.lit(0)))
        .select(*df.columns, name)
    )


def running_before(df: DataFrame, order: str, keys: list[str], value: str, name: str,
                   bits: int = BLOCK_BITS, levels: int = LEVELS) -> DataFrame:
    """Sum of ``value`` over the earlier rows of ``keys`` by ``order``; a key may hold any number of rows."""
    on = [*keys, "__block"]
    blocked = df.withColumn("__block", F.shiftright(order, bits))
    sums = blocked.groupBy(*on).agg(F.sum(value).alias("__n"))
    offsets = _earlier_sum(sums, keys, "__block", bits, levels - 1)
    window = W.partitionBy(*on).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    here = F.coalesce(F.sum(value).over(window), F.lit(0)) + F.coalesce("__before", F.lit(0))
    return blocked.join(offsets.withColumnRenamed("__n", "__before"), on, "left").withColumn(
        name, here).select(*df.columns, name)


def _earlier_sum(df: DataFrame, keys: list[str], order: str, bits: int, levels: int) -> DataFrame:
    if levels == 0:
        window = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
        return df.select(*keys, order, F.sum("__n").over(window).alias("__n"))
    block = f"__block{levels}"
    on = [*keys, block]
    blocked = df.withColumn(block, F.shiftright(order, bits))
    ends = blocked.groupBy(*on).agg(F.sum("__n").alias("__n"))
    carry = _earlier_sum(ends, keys, block, bits, levels - 1)
    window = W.partitionBy(*on).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    joined = blocked.join(carry.withColumnRenamed("__n", "__before"), on, "left")
    here = F.coalesce(F.sum("__n").over(window), F.lit(0)) + F.coalesce("__before", F.lit(0))
    return joined.select(*keys, order, here.alias("__n"))


def first_n(df: DataFrame, keys: list[str], by: list[Column], n: int,
            rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each key in the given order.

    Ranked twice: first within hashed parts of each key, then among the ``n`` best of the parts. A
    key that holds most rows is thereby spread over the parts, and Spark limits every map partition
    to ``n`` rows per key and part before the shuffle (window group limit).
    """
    part = F.pmod(F.xxhash64(*df.columns), F.lit(KEY_PARTS))
    parts = W.partitionBy(*keys, "__part").orderBy(*by)
    best = df.withColumn("__part", part).withColumn(rank, F.row_number().over(parts)).filter(F.col(rank) <= n)
    window = W.partitionBy(*keys).orderBy(*by)
    return best.drop("__part", rank).withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)


def positions(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Number the rows 0, 1, ... in a global order without a window over the whole table.

    A range sort is stored with row numbers that count within each of its partitions; the window
    runs over one row per partition only. Keep ``df`` narrow.
    """
    stored = materialise(df.orderBy(*order).withColumn("__mid", F.monotonically_increasing_id()), "positions")
    part = F.shiftright("__mid", 33)
    sizes = stored.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    within = F.col("__mid").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = stored.withColumn("__part", part).join(starts, "__part")
    return numbered.withColumn(name, F.col("__start") + within).drop("__mid", "__part", "__start")
