"""Rank documents for text queries with integer scores: inverted lists walked by Block-Max MaxScore.

Each run of documents that a task reads becomes a shard of at most ``SHARD_DOCS`` documents, with one row for
each of its terms: blocks of postings (numbers of documents and frequencies, packed) and, for each block,
its last document, its largest frequency and its shortest document. These give bounds under any corpus
statistics, so the index holds nothing that depends on other shards.

A shard answers a query in windows of documents. The lists' global bounds are summed from the lowest;
those whose sum stays below the current k-th score are non-essential and only documents of the others are
candidates. For each non-essential list, from the highest bound down, a candidate is dropped if its score
so far, the block's maximum and the bounds of the remaining lists can't reach the k-th score; only blocks that still hold
candidates are unpacked. The best of some shards are found first and hand their k-th score to the others,
so that those return nearly nothing in vain; the heaps of all shards are merged at the end.

Defined results:

- null text and text without terms: not counted in N, no candidate; an item without terms, with a null text
  or only with terms that no document has: no rows;
- an item's terms count once; rows of one item id are one item with the terms of all of them, rows with a
  null id among them are one item with a null id;
- ties go to the smaller id, null ids last; repeated rows of one id are candidates each and may be ranked
  each;
- no documents, or no items: no rows; other columns are ignored, whatever their names;
- long texts are taken whole, one text at a time in a task; terms are told apart by 64-bit hashes;
- all is exact while 50 n N stays below 2^63, n the terms of a document, N the number of documents.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cobaltmill.llm.common import text_batches
from cobaltmill.llm.shingles import batch_slices
from cobaltmill.llm.tokens import TERMS, token_hashes
from cobaltmill.operators.ordering import first_n
from cobaltmill.session import materialise, table

K = 50
#: Documents and terms (with repeats) after which a shard is closed; bytes of text taken at a time.
SHARD_DOCS = 1 << 14
SHARD_TERMS = 3 << 20
SLICE = 1 << 20
#: Postings in a block, documents in a window, items in a block of queries, shards to a first shard.
BLOCK = 128
WINDOW = 1 << 12
ITEMS = 256
FIRST_OF = 16
#: Parts of the shards that meet one block of items in a join.
SALTS = 64

NO_ID = np.iinfo(np.int64).max
INDEX = ("shard long, term long, block int, df int, lasts binary, tops binary, shorts binary, packed binary, "
         "ids binary, sizes binary, n_terms long")
FOUND = "item_id long, doc_id long, has_id boolean, score long"


def _cells(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Binary cells of ``counts`` values each."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32) * values.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(values.tobytes())])


def _changes(values: np.ndarray) -> np.ndarray:
    """True where a value differs from the one before."""
    return np.concatenate([np.ones(min(len(values), 1), bool), values[1:] != values[:-1]])


def _shard(number: int, ids: np.ndarray, sizes: np.ndarray, hashes: np.ndarray,
           block: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """One row per term, and one without a term that holds the documents.

    A posting is a gap of two bytes and a frequency of one, two or four; the first gap of a block is
    the number of its first document.
    """
    order = np.argsort(hashes, kind="stable")
    term, doc = hashes[order], np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)[order]
    new = np.flatnonzero(_changes(term) | _changes(doc))
    term, doc, tf = term[new], doc[new], np.diff([*new, len(doc)])
    lists = np.flatnonzero(_changes(term))
    df = np.diff([*lists, len(term)])
    blocks = -(-df // block)
    within = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    starts = np.repeat(lists, blocks) + within * block
    gaps = np.diff(doc, prepend=0)
    gaps[starts] = doc[starts]
    width = "<u1" if tf.max() < 1 << 8 else "<u2" if tf.max() < 1 << 16 else "<u4"
    postings = np.empty(len(doc), dtype=[("gap", "<u2"), ("tf", width)])
    postings["gap"], postings["tf"] = gaps, tf
    stops = np.append(starts[1:], len(doc))
    n = len(lists)
    none = pa.nulls(n, pa.binary())
    names = [field.split()[0] for field in INDEX.split(", ")]
    yield pa.RecordBatch.from_arrays([
        pa.array(np.full(n, number)), pa.array(term[lists].view(np.int64)),
        pa.array(np.full(n, block, np.int32)), pa.array(df.astype(np.int32)),
        _cells(doc[stops - 1].astype(np.int32), blocks), _cells(np.maximum.reduceat(tf, starts).astype(np.uint32), blocks),
        _cells(np.minimum.reduceat(sizes[doc], starts).astype(np.uint32), blocks), _cells(postings, df), none, none,
        pa.nulls(n, pa.int64())], names=names)
    none = pa.nulls(1, pa.binary())
    yield pa.RecordBatch.from_arrays([
        pa.array([number]), pa.nulls(1, pa.int64()), pa.array([block], pa.int32()), pa.array([len(ids)], pa.int32()), none, none, none, none,
        pa.array([ids.tobytes()], pa.binary()), pa.array([sizes.tobytes()], pa.binary()), pa.array([len(hashes)])],
        names=names)


def _indexer(shard_docs: int, block: int, size: int):
    def index(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, sizes, hashes, docs, terms = [], [], [], 0, 0

        def close() -> Iterator[pa.RecordBatch]:
            return _shard(number, np.concatenate(ids), np.concatenate(sizes), np.concatenate(hashes), block)

        for part in batch_slices(batches, "text", size):
            found, counts = token_hashes(part.column("text").to_pylist(), TERMS)
            some = counts > 0
            own = part.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
            if docs and (docs + some.sum() > shard_docs or terms + len(found) > SHARD_TERMS):
                yield from close()
                ids, sizes, hashes, docs, terms, number = [], [], [], 0, 0, number + 1
            ids.append(own[some])
            sizes.append(counts[some])
            hashes.append(found)
            docs, terms = docs + int(some.sum()), terms + len(found)
        if docs:
            yield from close()

    return index


def build_index(docs: DataFrame, shard_docs: int = SHARD_DOCS, block: int = BLOCK, size: int = SLICE) -> DataFrame:
    """The shards' lists for ``docs`` (doc_id, text); stored. Texts are not shuffled."""
    texts = text_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return materialise(texts.mapInArrow(_indexer(shard_docs, block, size), INDEX), "lexical-index", "zstd")


def _asker(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in batch_slices(batches, "text", 1 << 20):
        found, counts = token_hashes(part.column("text").to_pylist(), TERMS)
        at = np.repeat(np.arange(part.num_rows), counts)
        yield pa.RecordBatch.from_arrays(
            [part.column("item_id").take(pa.array(at)), pa.array(found.view(np.int64))], names=["item_id", "term"])


def item_terms(items: DataFrame) -> DataFrame:
    """``item_id, term`` of items (item_id, text), each once."""
    texts = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    return texts.mapInArrow(_asker, "item_id long, term long").distinct()


class _List:
    """One term's list in a shard, with its bounds under the corpus statistics."""

    def __init__(self, row: dict, norm):
        self.weight = row["weight"]
        self.size = row["block"]
        self.lasts = np.frombuffer(row["lasts"], np.int32)
        self.packed = row["packed"]
        width = len(self.packed) // row["df"] - 2
        self.kind = np.dtype([("gap", "<u2"), ("tf", f"<u{width}")])
        shorts = np.frombuffer(row["shorts"], np.uint32).astype(np.int64)
        self.bounds = self.weight * _impact(np.frombuffer(row["tops"], np.uint32).astype(np.int64), norm(shorts))
        self.bound = int(self.bounds.max())
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and frequencies of a block, unpacked when first asked for."""
        if k not in self.open:
            size = self.size * self.kind.itemsize
            cells = np.frombuffer(self.packed[k * size:(k + 1) * size], self.kind)
            self.open[k] = np.cumsum(cells["gap"], dtype=np.int64), cells["tf"].astype(np.int64)
        return self.open[k]

    def window(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Postings of the documents low to high - 1."""
        a, b = np.searchsorted(self.lasts, [low, high])
        found = [self.block(k) for k in range(a, min(b, len(self.lasts) - 1) + 1)]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        docs, tf = (np.concatenate(x) for x in zip(*found))
        a, b = np.searchsorted(docs, [low, high])
        return docs[a:b], tf[a:b]


def _impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


class _Heap:
    """The k best documents so far; a better k-th score may be known from elsewhere."""

    def __init__(self, k: int, floor: int):
        self.k, self.floor = k, max(floor, 1)
        self.rows: list[tuple[int, int, int]] = []

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        for s, i in zip(scores.tolist(), ids.tolist()):
            entry = (s, -i, len(self.rows))
            if len(self.rows) < self.k:
                heapq.heappush(self.rows, entry)
            elif entry[:2] > self.rows[0][:2]:
                heapq.heapreplace(self.rows, entry)
        if len(self.rows) == self.k:
            self.floor = max(self.floor, self.rows[0][0])


def _walk(lists: list[_List], ids: np.ndarray, m: np.ndarray, heap: _Heap, window: int = WINDOW) -> None:
    """Block-Max MaxScore over one shard."""
    lists = sorted((x for x in lists if x.bound > 0), key=lambda x: x.bound)
    sums = np.cumsum([x.bound for x in lists], dtype=np.int64)
    for low in range(0, len(ids), window):
        high = min(low + window, len(ids))
        loose = int(np.searchsorted(sums, heap.floor))  # the lists before it stay below the k-th score
        if loose == len(lists):
            return
        score, met = np.zeros(high - low, np.int64), np.zeros(high - low, bool)
        for x in lists[loose:]:
            docs, tf = x.window(low, high)
            score[docs - low] += x.weight * _impact(tf, m[docs])
            met[docs - low] = True
        at = np.flatnonzero(met)
        for n in range(loose - 1, -1, -1):
            at = at[score[at] + sums[n] >= heap.floor]
            if not len(at):
                break
            x, rest = lists[n], int(sums[n - 1]) if n else 0
            k = np.searchsorted(x.lasts, at + low)
            inside = k < len(x.lasts)
            limit = np.where(inside, x.bounds[np.minimum(k, len(x.lasts) - 1)], 0) + rest
            fits = score[at] + limit >= heap.floor
            at, k, inside = at[fits], k[fits], inside[fits]
            for b in np.unique(k[inside]).tolist():
                docs, tf = x.block(b)
                mine = at[k == b] + low
                place = np.minimum(np.searchsorted(docs, mine), len(docs) - 1)
                hit = docs[place] == mine
                mine, tf = mine[hit], tf[place[hit]]
                score[mine - low] += x.weight * _impact(tf, m[mine])
        at = at[score[at] >= heap.floor]
        if len(at) > heap.k:
            best = np.lexsort((ids[at + low], -score[at]))[:heap.k]
            at = at[best]
        heap.add(score[at], ids[at + low])


def _searcher(k: int, n_docs: int, n_terms: int, window: int):
    def norm(sizes: np.ndarray) -> np.ndarray:
        return 50 + (50 * sizes * n_docs) // n_terms

    def search(lists: pa.Table, items: pa.Table) -> pa.Table:
        out = []
        rows = {row["term"]: row for row in lists.to_pylist()}
        whole = rows.pop(None, None)
        if whole is not None:
            ids = np.frombuffer(whole["ids"], np.int64)
            m = norm(np.frombuffer(whole["sizes"], np.int64))
            built = {t: _List(row, norm) for t, row in rows.items()}
            for item in items.to_pylist():
                heap = _Heap(k, item["floor"])
                _walk([built[t] for t in item["terms"] if t in built], ids, m, heap, window)
                out += [(item["item_id"], -i, -i != NO_ID, s) for s, i, _ in heap.rows]
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64()]
        columns = list(zip(*out)) if out else [[], [], [], []]
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=["item_id", "doc_id", "has_id", "score"])

    return search


def search(index: DataFrame, terms: DataFrame, k: int = K, window: int = WINDOW, block_items: int = ITEMS,
           first_of: int = FIRST_OF) -> DataFrame:
    """The ``k`` best documents for each item of ``terms`` (item_id, term): ``item_id, rank, doc_id, score``."""
    whole = index.filter("term is null")
    totals = whole.agg(F.sum("df").alias("docs"), F.sum("n_terms").alias("terms")).first()
    n_docs, n_terms = int(totals["docs"] or 0), int(totals["terms"] or 0)
    numbers = materialise(whole.select("shard"), "lexical-shards")
    asked = materialise(terms, "lexical-terms")
    counted = index.select("term", "df").join(asked.select("term").distinct(), "term").groupBy("term").agg(
        F.sum("df").alias("df"))
    ratio = F.lit(2.0 * n_docs + 2) / (F.col("df") * 2 + 1).cast("double")
    weights = materialise(counted.select("term", F.floor(F.lit(1000.0) * F.log(ratio)).alias("weight")), "lexical-weights")
    asked = asked.join(weights.filter("weight > 0"), "term")
    blocks = max(1, -(-asked.select("item_id").distinct().count() // block_items))
    block = F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int").alias("asked")
    items = materialise(asked.groupBy("item_id").agg(F.collect_list("term").alias("terms")).select("*", block),
                        "lexical-items")
    wanted = materialise(asked.select("term", "weight", block).distinct(), "lexical-wanted")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("asked")

    def run(shards, floors: DataFrame) -> DataFrame:
        """Answers of the chosen shards; ``floors`` holds the k-th scores that are known."""
        lists = index.filter(shards).join(wanted, "term").select(*index.columns, "weight", "asked")
        own = whole.filter(shards).select("*", F.lit(0).cast("long").alias("weight"), every)
        given = items.join(floors, items["item_id"].eqNullSafe(floors["floor_id"]), "left").select(
            "item_id", "terms", F.coalesce("floor", F.lit(0)).cast("long").alias("floor"), "asked")
        salt = F.pmod(F.xxhash64("shard"), F.lit(SALTS)).cast("int").alias("salt")
        salted = given.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        spread = numbers.filter(shards).select("shard", salt, every).join(salted, ["asked", "salt"]).drop("salt")
        return lists.unionByName(own).groupBy("shard", "asked").cogroup(
            spread.groupBy("shard", "asked")).applyInArrow(_searcher(k, n_docs, n_terms, window), FOUND)

    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]

    def best(rows: DataFrame) -> DataFrame:
        named = rows.select("item_id", F.when(F.col("has_id"), F.col("doc_id")).alias("doc_id"), "score")
        return first_n(named, ["item_id"], order, k)

    first = F.pmod(F.xxhash64("shard"), F.lit(first_of)) == 0
    none = items.select(F.col("item_id").alias("floor_id"), F.lit(0).cast("long").alias("floor")).limit(0)
    early = materialise(run(first, none), "lexical-found")
    floors = materialise(best(early).filter(F.col("rank") == k).select(
        F.col("item_id").alias("floor_id"), F.col("score").alias("floor")), "lexical-floors")
    late = run(~first, floors)
    return best(early.unionByName(late)).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build_index(table(spark, sf_dir, "documents"))
    return search(index, item_terms(table(spark, sf_dir, "benchmark")))


SQL = rf"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents WHERE text IS NOT NULL),
sized AS (SELECT *, len(terms) AS n FROM docs WHERE len(terms) > 0),
corpus AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM sized),
numbered AS (SELECT row_number() OVER () AS r, * FROM sized),
posting AS (
  SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(terms) AS term FROM numbered)
  GROUP BY ALL),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
weight AS (
  SELECT term, floor(1000.0::DOUBLE * ln((2.0::DOUBLE * n_docs + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM posting, corpus GROUP BY term, n_docs),
scored AS (
  SELECT a.item_id, p.doc_id,
         sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM asked a JOIN posting p ON p.term = a.term JOIN weight t ON t.term = a.term CROSS JOIN corpus
  GROUP BY a.item_id, p.r, p.doc_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank
  FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {K}
"""
