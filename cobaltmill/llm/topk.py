"""Exact top-k by integer inner product with ball trees, branch and bound.

Vectors go to the nearest of at most 256 pivots, a bounded sample that decides the layout only; the vectors of a
pivot are cut into shards of bounded size by a hash. Each shard becomes a ball tree: nodes with centre, radius and
smallest id over one packed block of vectors. Queries form blocks by their nearest pivot as well. A block of queries
walks a shard's tree in the order of the nodes' upper bounds ``q.c + |q| r``; a node is skipped for a query whose
current k-th score is better. That score is shared: within a task it goes on from shard to shard, and a first
pass over one group of shards of the block's own pivot hands it to all that follow.

Then the roots of all shards, without their vectors, meet the blocks. Only groups of shards in which some query of
the block may still gain a row are sent to it. No task holds more than a group of shards and a block of
queries, and at most k rows for each query and group are shuffled for the last ranking.

Defined results:

- a vector that is null or empty, or holds a null or non-finite component, and a row with null id take
  no part;
- ties go to the smaller id; repeated candidate rows appear repeatedly; rows that share the query's id
  are all its own and no candidates of it;
- repeated query rows of one id count once (by the smallest vector); a query only meets vectors of its
  own length;
- a query without candidates and an empty table give no rows; other columns are ignored;
- components are ``floor(64 x)`` and exact while the scores stay below 2^53.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cobaltmill.session import materialise, table

K = 20
SCALE = 64
#: Vector components in a shard, shards in a group, queries in a block, vectors in a leaf.
SHARD_CELLS = 1 << 19
GROUP = 8
BLOCK = 512
LEAF = 128
#: Pivots of the layout at most, and shards whose roots are tested together.
PIVOTS = 256
ROOTS = 4096

INDEX = ("dim int, cell long, shard int, ids binary, vectors binary, kind string, centres binary, radii binary, "
         "kids binary, spans binary, least binary")
FOUND = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id`` and the integer vector ``v``, without rows that take no part."""
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = F.transform(x, lambda c: F.floor(c * scale).cast("double"))
    return vectors.filter((F.size("embedding") > 0) & F.col("vec_id").isNotNull() & ~bad).select(
        F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))


def _grow(points: np.ndarray, ids: np.ndarray):
    """Order of the points and the nodes: centre, radius, two children, span, smallest id."""
    order, nodes = np.arange(len(points)), []

    def node(start: int, stop: int) -> int:
        own = points[order[start:stop]]
        centre = own.mean(axis=0)
        radius = np.sqrt(((own - centre) ** 2).sum(axis=1).max())
        at = len(nodes)
        nodes.append([centre, radius, (-1, -1), (start, stop), ids[order[start:stop]].min()])
        spread = own.var(axis=0)
        if stop - start > LEAF and spread.max() > 0:
            axis, middle = int(spread.argmax()), (stop - start) // 2
            order[start:stop] = order[start:stop][np.argpartition(own[:, axis], middle)]
            nodes[at][2] = (node(start, start + middle), node(start + middle, stop))
        return at

    node(0, len(points))
    return order, nodes


def _small(points: np.ndarray) -> str:
    """The narrowest type that holds all values."""
    for kind in ("int8", "int16", "int32"):
        if len(points) and np.abs(points).max() <= np.iinfo(kind).max:
            return kind
    return "float64"


def _build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("vec_id", kind="stable")
    points = np.stack(rows["v"].to_numpy()).astype(np.float64)
    ids = rows["vec_id"].to_numpy(dtype=np.int64)
    order, nodes = _grow(points, ids)
    centres, radii, kids, spans, least = zip(*nodes)
    kind = _small(points)
    return pd.DataFrame([{
        "dim": key[0], "cell": key[1], "shard": key[2], "ids": ids[order].tobytes(), "kind": kind,
        "vectors": points[order].astype(kind).tobytes(),
        "centres": np.array(centres).tobytes(), "radii": np.array(radii).tobytes(),
        "kids": np.array(kids, dtype=np.int32).tobytes(),
        "spans": np.array(spans, dtype=np.int32).tobytes(),
        "least": np.array(least, dtype=np.int64).tobytes()}])


class _Best:
    """The best rows so far of a block of queries: score descending, then id ascending."""

    def __init__(self, ids: np.ndarray, k: int, score: np.ndarray, last: np.ndarray):
        self.ids, self.k = ids, k
        #: Score and id of the k-th row; a full list elsewhere may set them from the start.
        self.score, self.last = score.copy(), last.copy()
        self.rows = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))

    def add(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        q, s, i = (np.concatenate(x) for x in zip(self.rows, (at, score, ids)))
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        starts = np.flatnonzero(np.diff(q, prepend=-1))
        rank = np.arange(len(q)) - np.repeat(starts, np.diff([*starts, len(q)]))
        keep = rank < self.k
        self.rows = q[keep], s[keep], i[keep]
        full = np.flatnonzero(rank == self.k - 1)
        better = (s[full] > self.score[q[full]]) | (
            (s[full] == self.score[q[full]]) & (i[full] < self.last[q[full]]))
        self.score[q[full[better]]], self.last[q[full[better]]] = s[full[better]], i[full[better]]


def _search(block: np.ndarray, best: _Best, shard) -> None:
    """Walk one shard's tree for a block of queries."""
    dim = block.shape[1]
    ids = np.frombuffer(shard.ids, np.int64)
    vectors = np.frombuffer(shard.vectors, shard.kind).reshape(-1, dim)
    centres = np.frombuffer(shard.centres).reshape(-1, dim)
    kids = np.frombuffer(shard.kids, np.int32).reshape(-1, 2)
    spans = np.frombuffer(shard.spans, np.int32).reshape(-1, 2)
    least = np.frombuffer(shard.least, np.int64)
    length = np.sqrt((block ** 2).sum(axis=1))
    bound = block @ centres.T + length[:, None] * np.frombuffer(shard.radii)[None, :]
    bound += 1e-6 + 1e-9 * np.abs(bound)  # rounding must not cut off an exact score
    bound = np.floor(bound)  # scores are whole
    heap = [(-bound[:, 0].max(), 0)]
    while heap:
        _, n = heapq.heappop(heap)
        active = np.flatnonzero((bound[:, n] > best.score) | (
            (bound[:, n] == best.score) & (least[n] < best.last)))
        if not len(active):
            continue
        if kids[n, 0] >= 0:
            for kid in kids[n]:
                heapq.heappush(heap, (-bound[active, kid].max(), int(kid)))
            continue
        start, stop = spans[n]
        score = block[active] @ vectors[start:stop].astype(np.float64).T
        own = ids[start:stop]
        high = best.score[active][:, None]
        hit = ((score > high) | ((score == high) & (own[None, :] < best.last[active][:, None]))) & (
            own[None, :] != best.ids[active][:, None])
        at, column = np.nonzero(hit)
        if len(at):
            best.add(active[at], score[at, column], own[column])


def _searcher(k: int):
    def search(key: tuple, queries: pd.DataFrame, shards: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(shards):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype(
                {"query_id": "int64", "vec_id": "int64", "score": "float64"})
        block = np.stack(queries["v"].to_numpy()).astype(np.float64)
        ids = queries["query_id"].to_numpy(dtype=np.int64)
        best = _Best(ids, k, queries["kth"].to_numpy(dtype=np.float64),
                     queries["kth_id"].to_numpy(dtype=np.int64))
        for shard in shards.sort_values("shard").itertuples():
            _search(block, best, shard)
        q, score, found = best.rows
        return pd.DataFrame({"query_id": ids[q], "vec_id": found, "score": score})

    return search


def _worthwhile(key: tuple, queries: pd.DataFrame, roots: pd.DataFrame) -> pd.DataFrame:
    """Groups of shards in which some query of the block may gain a row."""
    if not len(queries) or not len(roots):
        return pd.DataFrame({"dim": [], "blk": [], "grp": []}).astype({"dim": "int32", "blk": "int64", "grp": "int64"})
    block = np.stack(queries["v"].to_numpy()).astype(np.float64)
    centres = np.frombuffer(b"".join(roots["centre"])).reshape(-1, block.shape[1])
    radii, least = np.frombuffer(b"".join(roots["radius"])), np.frombuffer(b"".join(roots["least"]), np.int64)
    bound = block @ centres.T + np.sqrt((block ** 2).sum(axis=1))[:, None] * radii[None, :]
    bound = np.floor(bound + 1e-6 + 1e-9 * np.abs(bound))
    kth, last = (queries[c].to_numpy()[:, None] for c in ("kth", "kth_id"))
    open_ = ((bound > kth) | ((bound == kth) & (least[None, :] < last))).any(axis=0)
    return pd.DataFrame({"dim": key[0], "blk": key[1], "grp": np.unique(roots["grp"].to_numpy()[open_])}).astype(
        {"dim": "int32", "blk": "int64", "grp": "int64"})


def _nearest(pivots: dict[int, np.ndarray]):
    """Number of the nearest pivot of a vector's length; 0 where none has it."""
    @F.pandas_udf("long")
    def cell(v: pd.Series) -> pd.Series:
        out, sizes = np.zeros(len(v), np.int64), v.map(len).to_numpy()
        for dim in set(sizes) & set(pivots):
            at, centres = np.flatnonzero(sizes == dim), pivots[dim]
            x = np.stack(v.iloc[at].to_numpy())
            out[at] = ((centres ** 2).sum(axis=1)[None, :] - 2 * (x @ centres.T)).argmin(axis=1)
        return pd.Series(out)

    return cell


def _numbered(cell: str, part: Column) -> Column:
    """One number for a cell and a part of it."""
    return F.shiftleft(F.col(cell), 32) + part


def build_index(points: DataFrame, cells: int = SHARD_CELLS, group: int = GROUP) -> tuple[DataFrame, dict]:
    """One row per shard with its ball tree and its group number, and the pivots by vector length."""
    size = points.agg(F.sum(F.size("v")).alias("n")).first()["n"] or 0
    wanted = max(1, min(PIVOTS, -(-size // cells) // group))
    pivots: dict[int, list] = {}
    for row in points.orderBy(F.xxhash64("vec_id", "v"), "vec_id", "v").limit(wanted).collect():
        pivots.setdefault(len(row["v"]), []).append(row["v"])
    pivots = {dim: np.array(rows, dtype=np.float64) for dim, rows in pivots.items()}
    dealt = points.select(F.size("v").alias("dim"), "vec_id", "v", _nearest(pivots)("v").alias("cell"))
    dealt = materialise(dealt, "top-dealt")
    sizes = materialise(dealt.groupBy("dim", "cell").agg(
        F.ceil(F.sum(F.col("dim").cast("long")) / cells).alias("shards")), "top-sizes")
    dealt = dealt.join(sizes, ["dim", "cell"]).select(
        "dim", "cell", F.pmod(F.xxhash64("vec_id", "v"), F.col("shards")).cast("int").alias("shard"), "vec_id", "v")
    index = dealt.groupBy("dim", "cell", "shard").applyInPandas(_build, INDEX)
    return materialise(index.withColumn("grp", _numbered("cell", F.floor(F.col("shard") / group))), "ball-trees"), pivots


def top_k(queries: DataFrame, points: DataFrame, k: int = K, block: int = BLOCK) -> DataFrame:
    """The ``k`` best rows of ``points`` (vec_id, v) for each row of ``queries`` (query_id, v).

    Returns ``query_id, rank, vec_id, score``.
    """
    index, pivots = build_index(points)
    asked = queries.groupBy("query_id").agg(F.min("v").alias("v"))
    asked = materialise(asked.select("query_id", "v", F.size("v").alias("dim"), _nearest(pivots)("v").alias("cell")),
                        "top-queries")
    # The parts of a cell among the queries, and among the index its groups; a block starts with one of these.
    blocks = asked.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    homes = index.groupBy("dim", "cell").agg(F.collect_set("grp").alias("homes"))
    layout = materialise(blocks.join(homes, ["dim", "cell"], "left"), "top-layout")
    part = F.pmod(F.xxhash64("query_id"), F.col("blocks"))
    asked = asked.join(layout, ["dim", "cell"]).select(
        "query_id", "v", "dim", _numbered("cell", part).alias("blk"),
        F.get("homes", F.pmod(part, F.greatest(F.size("homes"), F.lit(1))).cast("int")).alias("home"))
    asked = materialise(asked, "top-blocks")
    none = asked.withColumns({"kth": F.lit(float("-inf")), "kth_id": F.lit(-(1 << 63)).cast("long"), "grp": F.col("home")})

    def run(rows: DataFrame, pairs: DataFrame) -> DataFrame:
        keys = ["dim", "blk", "grp"]
        trees = index.join(pairs.select(*keys), ["dim", "grp"])
        trees = trees.toDF(*trees.columns)  # columns of its own; the rows may come from the same tables
        return rows.groupBy(*keys).cogroup(trees.groupBy(*keys)).applyInPandas(_searcher(k), FOUND)

    first_pairs = materialise(none.filter("grp is not null").select("dim", "blk", "grp").distinct(), "top-pairs")
    first = materialise(run(none.filter("grp is not null"), first_pairs), "top-first")
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = first.withColumn("_r", F.row_number().over(place)).filter(F.col("_r") == k).select(
        "query_id", F.col("score").alias("kth"), F.col("vec_id").alias("kth_id"))
    primed = asked.join(kth, "query_id", "left").withColumns({
        "kth": F.coalesce("kth", F.lit(float("-inf"))), "kth_id": F.coalesce("kth_id", F.lit(-(1 << 63)).cast("long"))})
    primed = materialise(primed, "top-primed")

    chunks = max(1, -(-index.count() // ROOTS))
    chunk = F.pmod(F.xxhash64("grp"), F.lit(chunks)).alias("chunk")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("chunk")
    roots = materialise(index.select(
        "dim", "grp", chunk, F.substring("centres", F.lit(1), F.col("dim") * 8).alias("centre"),
        F.substring("radii", 1, 8).alias("radius"), F.substring("least", 1, 8).alias("least")), "top-roots")
    meet = primed.select("dim", "blk").distinct().select("dim", "blk", every)
    keys = ["dim", "blk", "chunk"]
    near = roots.join(meet, ["dim", "chunk"])
    near = near.toDF(*near.columns)
    worth = primed.select("*", every).groupBy(*keys).cogroup(near.groupBy(*keys)).applyInPandas(
        _worthwhile, "dim int, blk long, grp long")
    pairs = materialise(worth.join(first_pairs, ["dim", "blk", "grp"], "left_anti"), "top-pairs")
    rest = run(primed.join(pairs, ["dim", "blk"]), pairs)
    ranked = first.unionByName(rest).withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id",
                         F.col("score").cast("long").alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = materialise(usable(table(spark, sf_dir, "embeddings")), "top-points")
    queries = points.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    return top_k(queries, points)


SQL = f"""
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE}.0::DOUBLE * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) AND q.vec_id % 20 = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank
  FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {K}
"""
