"""Score texts with an n-gram model by deleted interpolation.

The probability of a token is a mixture of the maximum-likelihood estimates of all orders and a uniform
one over the known tokens and one unknown token. The weights belong to buckets of the context's
frequency: the longest context that was seen, and the logarithm of its count. They are learned by
expectation-maximisation on held-out documents, a fixed share of those that are learned from; while
they are learned, the counts of these documents are deleted from all estimates. The final model counts all
documents that are learned from.

1. A task turns its texts into chunks: token numbers of a vocabulary of the chunk's own. A chunk
   holds documents of one kind (learned from, held out for the weights, only scored).
2. The distinct n-grams of a chunk, hashed and sorted, go in packs to the tasks that each count one range
   of hashes. Every chunk sends an n-gram once, however frequent it is, so no key is hot. What comes
   back are the counts that a chunk can't know, those that differ from its own.
3. Chunks meet their counts again and score their documents, the held-out ones first for the weights.

Texts are read once and never shuffled; counts are whole and grow with the corpus. N-grams are told
apart by 64-bit hashes.

Defined results:

- tokens are words with A-Z lower-cased, and one end for each text; null text, like the empty text, is
  one end;
- null id: learned from, not held out; repeated rows are documents each;
- nothing to learn from, or nothing held out for the weights: the orders that were seen weigh alike;
- an unknown token and an unknown context have a probability above 0, as every weight starts from
  one pseudo-count;
- a very long text is a chunk by itself; other columns are ignored, whatever their names; no rows: none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cobaltmill.llm.common import text_batches
from cobaltmill.llm.shingles import batch_slices, scramble
from cobaltmill.llm.tokens import WORDS, token_hashes
from cobaltmill.session import materialise, table

ORDER = 3
#: Of the documents that are learned from, one in so many is held out for the weights.
HELD_OF = 50
#: Tokens of a chunk, n-grams in one task that counts, bytes of text taken at a time.
CHUNK = 2 << 20
RANGE = 2 << 20
SLICE = 1 << 20
#: The most rounds of expectation-maximisation, and the gain of the mean log-likelihood that ends them.
ROUNDS = 20
GAIN = 1e-4

LEARNED, HELD, SCORED = 0, 1, 2
END = np.uint64(0x2545F4914F6CDD1D)
CHUNKS = "chunk long, kind int, ids binary, sizes binary, words binary, tokens binary, n_tokens long, n_docs long"
PACKS = "part int, chunk long, kind int, level int, hashes binary, counts binary"
COUNTED = "chunk long, kind int, level int, part int, places binary, seen binary, held binary, sums array<long>"
NO_ID = np.iinfo(np.int64).max


# --- chunks ---------------------------------------------------------------------------------------

def _squeeze(values: np.ndarray) -> bytes:
    """Unsigned 64-bit values as compressed planes of bytes, only as many as are used."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    packed = pa.compress(planes.tobytes(), codec="zstd", asbytes=True)
    return bytes((width,)) + len(values).to_bytes(7, "little") + packed


def _restore(data: bytes) -> np.ndarray:
    width, n = data[0], int.from_bytes(data[1:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], n * width, codec="zstd", asbytes=True), np.uint8)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = planes.reshape(width, n).T
    return out.reshape(-1).view("<u8")


def _chunk(number: int, kind: int, ids: list, sizes: list, hashes: list) -> pa.RecordBatch:
    """A chunk's row: its vocabulary by descending frequency, and its tokens as places in it."""
    ids, sizes, tokens = np.concatenate(ids), np.concatenate(sizes), np.concatenate(hashes)
    words, at, counts = np.unique(tokens, return_inverse=True, return_counts=True)
    order = np.argsort(-counts, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return pa.RecordBatch.from_arrays([
        pa.array([number]), pa.array([kind], pa.int32()), pa.array([ids.tobytes()], pa.binary()),
        pa.array([_squeeze(sizes)], pa.binary()), pa.array([words[order].tobytes()], pa.binary()),
        pa.array([_squeeze(place[at])], pa.binary()), pa.array([len(tokens)]), pa.array([len(ids)])],
        names=[f.split()[0] for f in CHUNKS.split(", ")])


def _with_ends(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The tokens with an end after each text."""
    return np.insert(hashes, np.cumsum(counts), END)


def _chunker(limit: int, size: int):
    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        open_: dict[int, tuple[list, list, list]] = {}
        for part in batch_slices(batches, "text", size):
            kinds = part.column("kind").to_numpy(zero_copy_only=False)
            ids = part.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
            hashes, counts = token_hashes(part.column("text").to_pylist(), WORDS)
            tokens, sizes = _with_ends(hashes, counts), counts + 1
            kind_of = np.repeat(kinds, sizes)
            for kind in np.unique(kinds).tolist():
                held = open_.setdefault(kind, ([], [], []))
                for into, values in zip(held, (ids[kinds == kind], sizes[kinds == kind], tokens[kind_of == kind])):
                    into.append(values)
                if sum(map(len, held[2])) >= limit:
                    yield _chunk(number, kind, *open_.pop(kind))
                    number += 1
        for kind, held in open_.items():
            yield _chunk(number, kind, *held)
            number += 1

    return cut


def chunks(docs: DataFrame, held_out: Column, held_of: int = HELD_OF, limit: int = CHUNK, size: int = SLICE) -> DataFrame:
    """The chunks of ``docs`` (doc_id, text); rows for which ``held_out`` holds are only scored. Stored."""
    share = F.pmod(F.xxhash64(F.lit(11), F.col("doc_id")), F.lit(held_of)) == 0
    kind = F.when(held_out, SCORED).when(share, HELD).otherwise(LEARNED)
    texts = text_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", kind.alias("kind"))
    return materialise(texts.mapInArrow(_chunker(limit, size), CHUNKS), "lm-chunks", "uncompressed")


# --- n-grams of a chunk ---------------------------------------------------------------------------

class _Grams:
    """The distinct n-grams of one chunk by level: hash, count, context, and where they stand.

    ``types[k]`` of a token is the place of the (k + 1)-gram that ends there, from 1 on; 0 is the start
    of a text, the empty context. ``context[k]`` is the place of its first k tokens at the level below.
    """

    def __init__(self, row: dict, order: int):
        self.chunk, self.kind = row["chunk"], row["kind"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.sizes = _restore(row["sizes"]).astype(np.int64)
        words = np.frombuffer(row["words"], np.uint64)
        token = _restore(row["tokens"]).astype(np.int32)
        first = np.zeros(len(token), bool)
        first[np.cumsum(self.sizes) - self.sizes] = True
        self.hashes, self.types, self.counts, self.context = [words], [token + 1], [np.bincount(token, minlength=len(words))], [None]
        for level in range(1, order):
            before = np.concatenate([[0], self.types[-1][:-1]])
            before[first] = 0
            pairs, at, counts = np.unique(before * len(words) + token, return_inverse=True, return_counts=True)
            del before
            context, last = pairs // len(words), pairs % len(words)
            below = np.concatenate([np.zeros(1, np.uint64), self.hashes[-1]])
            salt = np.uint64(0x9E3779B97F4A7C15 * level % 2 ** 64 | 1)
            self.hashes.append(scramble(below[context] * salt + scramble(words[last] + np.uint64(level))))
            self.types.append((at.reshape(-1) + 1).astype(np.int32))
            self.counts.append(counts)
            self.context.append(context)

    def packs(self, parts: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """``level, part`` and the places and hashes of its n-grams, sorted by hash."""
        for level, hashes in enumerate(self.hashes):
            order = np.argsort(hashes)
            part = ((hashes[order] >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
            edges = np.flatnonzero(np.diff(part.astype(np.int64), prepend=-1))
            for a, b in zip(edges, [*edges[1:], len(order)]):
                yield level, int(part[a]), order[a:b], hashes[order[a:b]]


def _packer(order: int, parts: int):
    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                grams = _Grams(batch.slice(k, 1).to_pylist()[0], order)
                rows = [(part, grams.chunk, grams.kind, level, _squeeze(np.diff(hashes, prepend=np.uint64(0))),
                         _squeeze(grams.counts[level][at])) for level, part, at, hashes in grams.packs(parts)]
                kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[f.split()[0] for f in PACKS.split(", ")])

    return pack


def _count(packs: pa.Table) -> pa.Table:
    """Sum the packs of one range of hashes; return to each the counts that it can't know."""
    rows = packs.to_pylist()
    del packs
    hashes = [np.cumsum(_restore(r["hashes"]), dtype=np.uint64) for r in rows]
    own = [_restore(r["counts"]).astype(np.int64) for r in rows]
    known, at = np.unique(np.concatenate(hashes), return_inverse=True)
    at = np.split(at.reshape(-1).astype(np.int32), np.cumsum([len(h) for h in hashes])[:-1])
    del hashes
    seen, held = np.zeros(len(known), np.int64), np.zeros(len(known), np.int64)
    words = np.zeros(len(known), bool)
    for r, a, c in zip(rows, at, own):
        if r["kind"] != SCORED:
            seen[a] += c
        if r["kind"] == HELD:
            held[a] += c
        if r["level"] == 0:
            words[a] = True
    out = []
    for r, a, c in zip(rows, at, own):
        mine = c if r["kind"] != SCORED else np.zeros_like(c)
        differs = seen[a] != mine
        if r["kind"] == HELD:
            differs |= held[a] != mine
        places = np.flatnonzero(differs)
        if len(places):
            out.append((r["chunk"], r["kind"], r["level"], r["part"], _squeeze(np.diff(places, prepend=0).astype(np.uint64)),
                        _squeeze(seen[a][places].astype(np.uint64)),
                        _squeeze(held[a][places].astype(np.uint64)) if r["kind"] == HELD else None, None))
    kept = seen - held
    out.append((-1, None, 0, rows[0]["part"], None, None, None, [
        int(seen[words].sum()), int((seen[words] > 0).sum()), int(kept[words].sum()), int((kept[words] > 0).sum())]))
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=[f.split()[0] for f in COUNTED.split(", ")])


def count(found: DataFrame, parts: int, order: int = ORDER) -> DataFrame:
    """Corpus counts of the chunks' n-grams where they differ from the chunk's own; sums under chunk -1. Stored."""
    packs = found.select("chunk", "kind", "ids", "sizes", "words", "tokens").mapInArrow(_packer(order, parts), PACKS)
    # each part is a task of its own: parts hold equal shares of the hashes
    return materialise(packs.groupBy("part").applyInArrow(_count, COUNTED), "lm-counts", "uncompressed")


# --- probabilities --------------------------------------------------------------------------------

def _counts_of(grams: _Grams, answers: list[dict], parts: int, starts: tuple[int, int]):
    """For each level the corpus counts and the held-out counts; place 0 is the start of texts."""
    mine = [c if grams.kind != SCORED else np.zeros_like(c) for c in grams.counts]
    seen = [np.concatenate([[starts[0]], m]) for m in mine]
    held = [np.concatenate([[starts[1]], m if grams.kind == HELD else np.zeros_like(m)]) for m in mine]
    told = {(a["level"], a["part"]): a for a in answers}
    for level, part, at, _ in grams.packs(parts):
        answer = told.get((level, part))
        if answer is not None:
            places = at[np.cumsum(_restore(answer["places"])).astype(np.int64)] + 1
            seen[level][places] = _restore(answer["seen"]).astype(np.int64)
            if answer["held"] is not None:
                held[level][places] = _restore(answer["held"]).astype(np.int64)
    return seen, held


def _estimates(grams: _Grams, counts: list[np.ndarray], n_tokens: int, n_words: int):
    """For each distinct n-gram of the highest order: estimates of all orders, uniform first, and its bucket."""
    top = len(counts) - 1
    p = np.zeros((top + 2, len(grams.counts[top])))
    p[0] = 1 / (n_words + 1)
    bucket = np.zeros(p.shape[1], np.int64)
    # the lower n-grams that end each n-gram: those of one of its tokens
    one = np.zeros(len(grams.counts[top]) + 1, np.int64)
    one[grams.types[top]] = np.arange(len(grams.types[top]))
    one = one[1:]
    for level in range(top + 1):
        at = grams.types[level][one]
        if level == 0:
            context = np.full(len(at), n_tokens)
        else:
            context = counts[level - 1][grams.context[level][at - 1]]
            bucket = np.where(context > 0, 64 * level + np.log2(np.maximum(context, 1)).astype(np.int64), bucket)
        p[level + 1] = np.where(context > 0, counts[level][at] / np.maximum(context, 1), 0)
    return p, bucket


def _held_rows(order: int, parts: int, sums: dict):
    def rows(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        told = answers.to_pylist()
        for row in chunk.to_pylist():
            grams = _Grams(row, order)
            seen, held = _counts_of(grams, told, parts, (sums["docs"], sums["held_docs"]))
            p, bucket = _estimates(grams, [s - h for s, h in zip(seen, held)], sums["kept"], sums["kept_words"])
            out.append((bucket, grams.counts[-1], *p))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0)] * (order + 3)
        kinds = [pa.int64(), pa.int64(), *[pa.float64()] * (order + 1)]
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)],
                        names=["bucket", "n", *[f"p{k}" for k in range(order + 1)]])

    return rows


def learn_weights(rows: DataFrame, order: int = ORDER) -> dict[int, list[float]]:
    """Weights of the estimates ``p0...`` by ``bucket``, by expectation-maximisation over rows with weight ``n``.

    There are at most 64 buckets for each order.
    """
    names = [f"p{k}" for k in range(order + 1)]
    buckets = [r["bucket"] for r in rows.select("bucket").distinct().collect()]
    weights = {b: [1 / (b // 64 + 2) if k <= b // 64 + 1 else 0.0 for k in range(order + 1)] for b in buckets}
    last = None
    for _ in range(ROUNDS):
        if not buckets:
            break
        given = F.create_map(*[c for b, w in weights.items() for c in (F.lit(b).cast("long"), F.array(*map(F.lit, w)))])
        parts = [F.get("w", k) * F.col(name) for k, name in enumerate(names)]
        whole = sum(parts[1:], parts[0])
        stepped = rows.withColumn("w", F.element_at(given, F.col("bucket"))).groupBy("bucket").agg(
            *[F.sum(F.col("n") * p / whole).alias(name) for p, name in zip(parts, names)],
            F.sum("n").alias("n"), F.sum(F.col("n") * F.log(whole)).alias("fit")).collect()
        for r in stepped:
            able = r["bucket"] // 64 + 2
            mass = [r[name] + 1 if k < able else 0.0 for k, name in enumerate(names)]
            weights[r["bucket"]] = [m / sum(mass) for m in mass]
        fit = sum(r["fit"] for r in stepped) / sum(r["n"] for r in stepped)
        if last is not None and fit - last < GAIN:
            break
        last = fit
    return weights


def mixture(p: np.ndarray, bucket: np.ndarray, weights: dict[int, list[float]]) -> np.ndarray:
    """The mixed probability; a bucket without weights takes those of the nearest bucket of its order."""
    order = len(p) - 1
    out = np.empty(p.shape[1])
    for b in np.unique(bucket).tolist():
        near = [x for x in weights if x // 64 == b // 64]
        able = b // 64 + 2
        w = weights[min(near, key=lambda x: (abs(x - b), x))] if near else [1 / able] * able + [0.0] * (order + 1 - able)
        here = bucket == b
        out[here] = np.array(w) @ p[:, here]
    return out


def _scorer(order: int, parts: int, sums: dict, weights: dict[int, list[float]]):
    def score(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        told = answers.to_pylist()
        for row in chunk.to_pylist():
            grams = _Grams(row, order)
            seen, _ = _counts_of(grams, told, parts, (sums["docs"], sums["held_docs"]))
            p, bucket = _estimates(grams, seen, sums["tokens"], sums["words"])
            logs = np.log10(mixture(p, bucket, weights))[grams.types[-1] - 1]
            c = seen[0][grams.types[0]]
            base = np.log10((c + 0.5) / (sums["tokens"] + 0.5 * (sums["words"] + 1)))
            starts = np.cumsum(grams.sizes) - grams.sizes
            out.append((grams.ids, np.full(len(starts), grams.kind == SCORED), grams.sizes,
                        np.add.reduceat((c > 0).astype(np.int64), starts), np.add.reduceat(base, starts),
                        np.add.reduceat(logs, starts)))
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        columns = [np.concatenate(c) for c in zip(*out)] if out else [[]] * 6
        arrays = [pa.array(c, t) for c, t in zip(columns, kinds)]
        if out:
            arrays[0] = pa.array(columns[0], pa.int64(), mask=columns[0] == NO_ID)
        return pa.table(arrays, names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return score


def score(docs: DataFrame, held_out: Column, order: int = ORDER) -> DataFrame:
    """``score_chunks`` of ``docs`` (doc_id, text), learning from the rows that aren't ``held_out``."""
    return score_chunks(chunks(docs, held_out), order)


def score_chunks(found: DataFrame, order: int = ORDER, grams: int = RANGE) -> DataFrame:
    """Log10 probabilities of the chunks' texts under the model of those that are learned from.

    Returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row; ``base_score`` is
    that of a unigram model with half a count added to each token.
    """
    taken = found.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(name) for name, c in (
        ("size", F.col("n_tokens")), ("docs", F.when(F.col("kind") != SCORED, F.col("n_docs"))),
        ("held_docs", F.when(F.col("kind") == HELD, F.col("n_docs"))))]).first().asDict()
    parts = max(1, -(-taken["size"] * order // grams))
    told = count(found, parts, order)
    sums = taken | told.filter("chunk = -1").agg(
        *[F.coalesce(F.sum(F.get("sums", k)), F.lit(0)).alias(name)
          for k, name in enumerate(("tokens", "words", "kept", "kept_words"))]).first().asDict()

    def meet(which: Column, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
        answers = told.filter("chunk >= 0").filter(which).select("chunk", "level", "part", "places", "seen", "held")
        return found.filter(which).groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(work, schema)

    names = ", ".join(f"p{k} double" for k in range(order + 1))
    rows = materialise(meet(F.col("kind") == HELD, _held_rows(order, parts, sums), f"bucket long, n long, {names}"),
                       "lm-held")
    weights = learn_weights(rows, order)
    scored = meet(F.lit(True), _scorer(order, parts, sums, weights), (
        "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"))
    return scored.withColumn("train_tokens", F.lit(sums["tokens"]).cast("long"))


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, is_held_out(F.col("doc_id")))
