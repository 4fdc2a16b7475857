"""Pairwise-complete moments of many columns as one mergeable state.

For each pair of columns the state holds the number of rows where both are known, both means, both sums of squares
and the sum of products around these means. A task builds it batch by batch with matrix products and
merges batches by Chan's formula; the tasks' states are merged in a tree.

A batch is shifted by one known value of each column. Where a pair's own rows lie so far from that shift that
digits would be lost, the pair is computed again from its rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cobaltmill.session import materialise

#: States merged by one task, and rows worked on at a time.
FAN_IN = 64
RUN = 1 << 13
#: A pair is computed again if its squared distance from the shift exceeds this many times its spread.
LOST = 1e3
STATE = "task long, state binary"


def batch_state(x: np.ndarray) -> np.ndarray:
    """State of a batch of rows, NaN for unknown: n, means, squares, products, each columns by columns.

    ``means[i, j]`` and ``squares[i, j]`` are those of column i over the rows where j is known too.
    """
    known = ~np.isnan(x)
    mask = known.astype(np.float64)
    shift = np.where(known.any(axis=0), x[known.argmax(axis=0), np.arange(x.shape[1])], 0.0)
    y = np.where(known, x - shift, 0.0)
    n = mask.T @ mask
    count = np.maximum(n, 1)
    means = (y.T @ mask) / count
    squares = (y * y).T @ mask - n * means ** 2
    products = y.T @ y - n * means * means.T
    far = n * means ** 2 > LOST * np.maximum(squares, 0)
    means = shift[:, None] + means
    far = (far | far.T) & (n > 0)
    for i, j in zip(*np.nonzero(np.triu(far))):
        both = known[:, i] & known[:, j]
        a, b = x[both, i] - x[both, i][0], x[both, j] - x[both, j][0]
        ma, mb = a.mean(), b.mean()
        a, b = a - ma, b - mb
        means[i, j], means[j, i] = x[both, i][0] + ma, x[both, j][0] + mb
        squares[i, j], squares[j, i] = a @ a, b @ b
        products[i, j] = products[j, i] = a @ b
    return np.stack([n, means, np.maximum(squares, 0), products])


def merged(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The state of the rows of both."""
    n = one[0] + other[0]
    share = other[0] / np.maximum(n, 1)
    apart = other[1] - one[1]
    apart[(one[0] == 0) | (other[0] == 0)] = 0
    weight = one[0] * share
    means = np.where(one[0] == 0, other[1], one[1] + apart * share)
    return np.stack([n, means, one[2] + other[2] + weight * apart ** 2, one[3] + other[3] + weight * apart * apart.T])


def _builder(width: int):
    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = np.zeros((4, width, width))
        for batch in batches:
            columns = [c.fill_null(np.nan).to_numpy(zero_copy_only=False) for c in batch.columns]
            for at in range(0, batch.num_rows, RUN):
                state = merged(state, batch_state(np.column_stack([c[at:at + RUN] for c in columns])))
        yield pa.RecordBatch.from_arrays(
            [pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([state.tobytes()], pa.binary())],
            names=["task", "state"])

    return build


def _merger(width: int):
    def merge(states: pa.Table) -> pa.Table:
        whole = np.zeros((4, width, width))
        for state in states.column("state").to_pylist():
            whole = merged(whole, np.frombuffer(state).reshape(4, width, width))
        task = states.column("task")[0].as_py() // FAN_IN
        return pa.table({"task": pa.array([task], pa.int64()), "state": pa.array([whole.tobytes()], pa.binary())})

    return merge


def _reader(names: list[str]):
    def read(states: pa.Table) -> pa.Table:
        width = len(names)
        n, _, squares, products = np.frombuffer(states.column("state")[0].as_py()).reshape(4, width, width)
        spread = np.sqrt(squares) * np.sqrt(squares.T)
        r = np.divide(products, spread, out=np.full_like(products, np.nan), where=spread > 0)
        row, col = np.repeat(np.arange(width), width), np.tile(np.arange(width), width)
        kind = pa.array(names, pa.string())
        return pa.table({
            "row": kind.take(pa.array(row)), "col": kind.take(pa.array(col)),
            "n": pa.array(n.reshape(-1).astype(np.int64)), "r": pa.array(r.reshape(-1), from_pandas=True)})

    return read


def correlations(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """``row, col, n, r`` for each pair of the named double columns, over the rows where both are known.

    Nulls, NaN and infinite values are unknown. ``r`` is null where a column has no spread or there are no such rows.
    """
    names = list(values)
    cells = [F.when(F.abs(c) < float("inf"), F.nanvl(c, F.lit(None))).alias(f"v{i}") for i, c in enumerate(values.values())]
    states = materialise(df.select(*cells).mapInArrow(_builder(len(names)), STATE), "co-moments")
    top = states.agg(F.max("task")).first()[0] or 0
    while top > 0:
        states = states.groupBy(F.floor(F.col("task") / FAN_IN).alias("part")).applyInArrow(_merger(len(names)), STATE)
        top //= FAN_IN
        if top >= FAN_IN:
            states = materialise(states, "co-moments")
    read = "row string, col string, n long, r double"
    return states.groupBy("task").applyInArrow(_reader(names), read)
