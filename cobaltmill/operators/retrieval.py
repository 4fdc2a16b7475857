"""Vector search over an index of (vec_id, embedding, tenant ...)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cobaltmill.functions import text as T
from cobaltmill.functions import vocab
from cobaltmill.operators.ordering import first_n
from cobaltmill.session import materialise

# Queries that are scored together, vectors of a packed piece of the index, and vectors that meet one copy of
# the queries.
QUERY_BLOCK = 256
CHUNK_ROWS = 4096
PART_ROWS = 4 * CHUNK_ROWS


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def _runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of each group and part of a batch of (group, part, id, vector)."""
    codes = batch.column(0).dictionary_encode().indices.to_numpy()
    parts = batch.column(1).to_numpy()
    order = np.lexsort((parts, codes))
    edges = np.flatnonzero((np.diff(codes[order]) != 0) | (np.diff(parts[order]) != 0)) + 1
    for rows in np.split(order, edges):
        yield batch.take(pa.array(rows))


def _pack(rows: int, names: tuple[str, str]):
    """Rows (group, part, id, vector) as pieces of at most ``rows``: unit vectors in one binary, ids in another.

    Each piece holds vectors of one size. Null ids, and vectors that are empty or hold null or non-finite
    values, take no part.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sized = pc.fill_null(pc.list_value_length(batch.column(3)), 0)
            batch = batch.filter(pc.and_(pc.greater(sized, 0), pc.is_valid(batch.column(2))))
            for own in _runs(batch) if batch.num_rows else ():
                sizes = pc.list_value_length(own.column(3))
                for dim in pc.unique(sizes).to_pylist():
                    same = own.filter(pc.equal(sizes, dim))
                    vectors = _matrix(same.column(3), dim)
                    sound = np.isfinite(vectors).all(axis=1)
                    ids = same.column(2).cast(pa.int64()).to_numpy()[sound]
                    vectors = _unit(vectors[sound])
                    for at in range(0, len(ids), rows):
                        yield pa.RecordBatch.from_arrays(
                            [own.column(0).slice(0, 1), own.column(1).slice(0, 1), pa.array([dim], pa.int32()),
                             pa.array([ids[at:at + rows].tobytes()]), pa.array([vectors[at:at + rows].tobytes()])],
                            names=["group", "part", "dim", *names])

    return run


def _best(k: int):
    """Scores a block of queries against a piece of the index and keeps the best ``k`` of each query."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = {name: batch.column(name)[at].as_py() for name in batch.schema.names}
                queries = np.frombuffer(row["query_vectors"]).reshape(-1, row["dim"])
                vectors = np.frombuffer(row["vectors"]).reshape(-1, row["dim"])
                ids = np.frombuffer(row["ids"], np.int64)
                scores = queries @ vectors.T
                worst = np.partition(scores, -k, axis=1)[:, [-k]] if len(ids) > k else -np.inf
                which, where = np.nonzero(scores >= worst)  # ties with the k-th score stay in
                score, found = scores[which, where], ids[where]
                order = np.lexsort((found, -score, which))
                which, score, found = which[order], score[order], found[order]
                kept = np.arange(len(which)) - np.searchsorted(which, which) < k
                asked = np.frombuffer(row["query_ids"], np.int64)[which[kept]]
                group = pa.array([row["group"]] * len(asked), batch.schema.field("group").type)
                yield pa.RecordBatch.from_arrays(
                    [group, pa.array(asked), pa.array(found[kept]), pa.array(score[kept])],
                    names=["group", "query_id", "vec_id", "score"])

    return run


def _packed(rows: DataFrame, size: int, ids: str, vectors: str) -> DataFrame:
    kind = rows.schema["group"].dataType.simpleString()
    return rows.mapInArrow(_pack(size, (ids, vectors)), f"group {kind}, part long, dim int, {ids} binary, {vectors} binary")


def _ranked(pieces: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of every query (group, query_id) among the pieces of its group, part by part."""
    kind = pieces.schema["group"].dataType.simpleString()
    scored = pieces.join(blocks, ["group", "part", "dim"]).mapInArrow(
        _best(k), f"group {kind}, query_id long, vec_id long, score double")
    return first_n(scored, ["group", "query_id"], [F.col("score").desc(), F.col("vec_id")], k)


def _every_part(blocks: DataFrame, parts: Column) -> DataFrame:
    """A copy of each block of queries for every part of the index."""
    every = F.sequence(F.lit(0).cast("long"), parts.cast("long") - 1)
    return blocks.withColumn("part", F.explode(every))


def cosine_topk(index: DataFrame, queries: DataFrame, k: int = vocab.TOP_K, id_col: str = "vec_id",
                vec_col: str = "embedding") -> DataFrame:
    """Exact top ``k`` by cosine for every query (query_id, vector); ties go to the smaller id.

    The index is packed into pieces, the queries into blocks; the index has as many parts as its number of
    rows asks for. A block is copied to each part and scored piece by piece, and only ``k`` rows per query
    and piece reach the ranking. Vectors of another size than the query's take no part, nor do vectors
    with null or non-finite values. Ids are whole numbers.
    """
    parts = max(1, -(-index.count() // PART_ROWS))
    none = F.lit(0).alias("group"), F.lit(0).cast("long").alias("part")
    pieces = _packed(index.select(*none, id_col, vec_col), CHUNK_ROWS, "ids", "vectors").withColumn(
        "part", F.pmod(F.xxhash64("ids"), F.lit(parts)))
    blocks = materialise(
        _packed(queries.select(*none, "query_id", "vector"), QUERY_BLOCK, "query_ids", "query_vectors"), "queries")
    return _ranked(pieces, _every_part(blocks, F.lit(parts)), k).drop("group")


def tenant_search(index: DataFrame, tenant: str, value, queries: DataFrame,
                  k: int = vocab.TOP_K) -> DataFrame:
    """Search one tenant only; on an index stored by tenant the other folders are not read."""
    return cosine_topk(index.filter(F.col(tenant) == value), queries, k)


def tenant_topk(index: DataFrame, requests: DataFrame, tenant: str, k: int = vocab.TOP_K) -> DataFrame:
    """Each request (query_id, tenant, vector) searches the vectors of its own tenant.

    A tenant may ask several times; every request gets its own ``k``. Vectors of another size than
    the request's take no part, nor do vectors with null or non-finite values. Ids are whole numbers.

    Only tenants that ask are read on. Their vectors are packed by tenant and part, a large tenant having
    as many parts as its number of vectors asks for, and scored as matrices against the tenant's requests.
    """
    wanted = materialise(requests.select(F.col(tenant).alias("group"), "query_id", "vector"), "requests")
    asked = wanted.groupBy("group").agg(F.count(F.lit(1)).alias("asked"))
    held = index.groupBy(F.col(tenant).alias("group")).agg(F.count(F.lit(1)).alias("held"))
    sizes = materialise(asked.join(held, "group").select(
        "group", F.ceil(F.col("held") / PART_ROWS).alias("parts"), F.ceil(F.col("asked") / PART_ROWS).alias("heaps")), "sizes")

    def dealt(rows: DataFrame, id_col: str, vec_col: str, parts: str) -> DataFrame:
        """Rows of one tenant and part side by side, so that pieces are full."""
        rows = rows.join(sizes, "group").select(
            "group", F.pmod(F.xxhash64(id_col), F.col(parts)).alias("part"), id_col, vec_col)
        return rows.repartition("group", "part").sortWithinPartitions("group", "part")

    vectors = index.select(F.col(tenant).alias("group"), "vec_id", "embedding")
    pieces = _packed(dealt(vectors, "vec_id", "embedding", "parts"), CHUNK_ROWS, "ids", "vectors")
    blocks = materialise(
        _packed(dealt(wanted, "query_id", "vector", "heaps"), QUERY_BLOCK, "query_ids", "query_vectors"), "queries")
    found = _ranked(pieces, _every_part(blocks.join(sizes, "group"), F.col("parts")).drop("parts", "heaps"), k)
    return found.withColumnRenamed("group", tenant)


def context_assemble(hits: DataFrame, keys: list[str], rank: str, source: str, text: str) -> DataFrame:
    """The ranked texts of each key as one context; at most a handful of hits per key."""
    body = T.strip(F.coalesce(text, F.lit("")))
    shown = hits.withColumn("__text", body).filter(F.col("__text") != "")
    entry = F.concat(F.lit("[Fuente: "), F.coalesce(source, F.lit("documento")), F.lit("]\n"), "__text")
    entries = F.sort_array(F.collect_list(F.struct(F.col(rank).alias("r"), entry.alias("t"))))
    joined = F.array_join(F.transform(entries, lambda e: e["t"]), "\n\n---\n\n")
    return shown.groupBy(*keys).agg(joined.alias("context"))
