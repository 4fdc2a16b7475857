"""Language identification by the nearest of several centroids per language.

A text is lower-cased, everything but letters becomes one space, and its character 1- to 3-grams are
hashed to ``DIMS`` counts; the vector is ``1 + log(count)`` times the n-gram's inverse document
frequency, of length 1. Document frequencies come from all documents that may be learned from. The
centroids come from at most ``PER_LANG`` documents of each language (those with the smallest hash of
the id), by spherical k-means within the language. A text gets the language of the centroid with the
largest cosine; it is rejected if that cosine is far below those of the language's own members.

Cosines grow with the number of dimensions that a text fills, for members and, by collisions, for texts in
any script. So a text is compared with members that fill about as many: each language has a floor per
octave of filled dimensions, a low quantile that a few odd members don't move. An octave with few members
takes in the ones below it; those under the first that has enough share its floor.

The driver holds document frequencies (``DIMS`` numbers), ``CENTROIDS`` vectors and ``BANDS`` floors per
language.

Defined results:

- null text or one without letters: ``und``, score 0, rejected;
- null language or null id: never learned from; a null id isn't held out;
- no document to learn from: ``und``, score 0, not rejected if the text has letters;
- ties between centroids go to the language that sorts first; repeated rows get equal results;
- an empty table gives no rows; other columns pass through ``identify``, and columns with the names of
  its results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cobaltmill.llm.common import text_batches
from cobaltmill.llm.shingles import batch_slices
from cobaltmill.operators.ordering import first_n
from cobaltmill.session import materialise, table

DIMS = 4096
SLICE, ROWS = 1 << 20, 256
PER_LANG = 400
CENTROIDS = 3
#: A text is rejected below this share of its floor's square; the floor is the ``LOW`` quantile of the members'
#: cosines. The square leaves room for short texts, whose cosines scatter.
REJECT_BELOW = 0.45
LOW, LEAST = 0.05, 10
BANDS = DIMS.bit_length()
NONE = "und"
MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


class Ngrams:
    """Hashed counts of letter n-grams."""

    def __init__(self, dims: int = DIMS):
        self.dims = dims
        self.letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)

    def codes(self, text: str) -> np.ndarray:
        """Letters with single spaces between runs of them, and one before and after."""
        raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = self.letter[raw]
        before = np.concatenate([[False], letter[:-1]])
        kept = np.where(letter, raw, 32)[letter | before]
        if not len(kept):
            return kept
        return np.concatenate([[32], kept, [32] if letter[-1] else []]).astype(np.uint32)

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """One row of counts per text; a text without letters has none."""
        out = np.zeros((len(texts), self.dims), dtype=np.float32)
        shift = np.uint32(32 - (self.dims.bit_length() - 1))
        for row, text in enumerate(texts):
            code = self.codes(text) if text else ()
            if not len(code):
                continue
            rolled = np.zeros(len(code), dtype=np.uint32)
            for n, by in enumerate(MULTIPLIERS):
                rolled = (rolled[:len(code) - n] + code[n:]) * np.uint32(by)
                spot = (rolled ^ (rolled >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> shift
                out[row] += np.bincount(spot, minlength=self.dims)
        return out


def _slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in batch_slices(batches, "text", SLICE):
        for start in range(0, part.num_rows, ROWS):
            yield part.slice(start, ROWS)


def unit(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF vectors of length 1 (or 0)."""
    weight = np.log1p(counts) * idf
    norm = np.sqrt((weight * weight).sum(axis=1, keepdims=True))
    return weight / np.where(norm > 0, norm, 1)


def document_frequency(docs: DataFrame) -> tuple[int, np.ndarray]:
    """The number of texts with letters and, per dimension, of those that have it."""
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, total, texts = Ngrams(), np.zeros(DIMS, np.int64), 0
        for part in _slices(batches):
            seen = grams.counts(part.column("text").to_pylist()) > 0
            total += seen.sum(axis=0)
            texts += int(seen.any(axis=1).sum())
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(DIMS + 1, dtype=np.int32)), pa.array(np.append(total, texts))], ["dim", "n"])

    rows = text_batches(docs).select("text").mapInArrow(count, "dim int, n long").groupBy("dim").agg(
        F.sum("n").alias("n")).collect()
    out = np.zeros(DIMS + 1, np.int64)
    for row in rows:
        out[row["dim"]] = row["n"]
    return int(out[DIMS]), out[:DIMS]


def band(counts: np.ndarray) -> np.ndarray:
    """The octave of the number of dimensions that each text fills."""
    return np.log2(np.maximum((counts > 0).sum(axis=1), 1)).astype(np.int64)


def _floors(cosine: np.ndarray, bands: np.ndarray) -> np.ndarray:
    """A low quantile of the members' cosines for each band, not below the second smallest."""
    out, least = np.zeros(BANDS), min(LEAST, len(bands))
    first = int(np.sort(bands)[least - 1])
    for b in range(BANDS):
        low = b = max(b, first)
        while (near := (bands >= low) & (bands <= b)).sum() < least:
            low -= 1
        out[b] = np.quantile(cosine[near], max(LOW, 1 / max(near.sum() - 1, 1)))
    out[:first] = out[first]
    return out


def _cluster(points: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from farthest points; centroids and each point's cosine with the nearest."""
    centre = points.mean(axis=0)
    centres = [centre / max(np.linalg.norm(centre), 1e-12)]
    while len(centres) < min(k, len(points)):
        near = (points @ np.stack(centres).T).max(axis=1)
        centres.append(points[int(near.argmin())])
    centres = np.stack(centres)
    for _ in range(20):
        own = (points @ centres.T).argmax(axis=1)
        moved = centres.copy()
        for c in range(len(centres)):
            if (own == c).any():
                mean = points[own == c].mean(axis=0)
                moved[c] = mean / max(np.linalg.norm(mean), 1e-12)
        if np.allclose(moved, centres):
            break
        centres = moved
    return centres, (points @ centres.T).max(axis=1)


def learn(docs: DataFrame, lang: str = "lang", per_lang: int = PER_LANG, centroids: int = CENTROIDS) -> dict:
    """A model from rows (doc_id, text, lang): ``idf, langs, centres, floors`` as arrays."""
    known = docs.filter(F.col(lang).isNotNull() & F.col("doc_id").isNotNull()).select(
        "doc_id", "text", F.col(lang).cast("string").alias("lang"))
    texts, seen = document_frequency(known)
    idf = np.log((1 + texts) / (1 + seen)).astype(np.float32) + np.float32(1)
    ranked = first_n(known.select("doc_id", "lang"), ["lang"], [F.xxhash64("doc_id"), F.col("doc_id")], per_lang)
    chosen = ranked.select("doc_id", "lang").distinct()
    sample = known.join(materialise(chosen, "lang-chosen"), ["doc_id", "lang"], "left_semi")

    def cluster(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "text"], kind="stable").head(2 * per_lang)
        counts = Ngrams().counts(rows["text"].tolist())
        counts = counts[counts.any(axis=1)]
        if not len(counts):
            return pd.DataFrame({"lang": [rows["lang"].iloc[0]], "floors": [b""], "centre": [b""]})
        centres, cosine = _cluster(unit(counts, idf), centroids)
        return pd.DataFrame({"lang": rows["lang"].iloc[0], "floors": _floors(cosine, band(counts)).tobytes(),
                             "centre": [c.astype(np.float32).tobytes() for c in centres]})

    rows = sample.groupBy("lang").applyInPandas(cluster, "lang string, floors binary, centre binary").collect()
    rows = sorted((r for r in rows if r["centre"]), key=lambda r: (r["lang"], r["centre"]))
    return {"idf": idf, "langs": [r["lang"] for r in rows],
            "floors": np.stack([np.frombuffer(r["floors"]) for r in rows]) if rows else np.zeros((0, BANDS)),
            "centres": np.stack([np.frombuffer(r["centre"], np.float32) for r in rows])
            if rows else np.zeros((0, DIMS), np.float32)}


def identify(docs: DataFrame, model: dict, reject_below: float = REJECT_BELOW,
             keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``lang_pred, score, rejected`` from the column ``text``.

    ``keep`` names the columns that go on (all by default); the others need not come back from the workers.
    """
    made = ["lang_pred", "score", "rejected"]
    docs = docs.drop(*made)
    names = docs.columns if keep is None else keep
    schema = T.StructType([*[docs.schema[n] for n in names], T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    arrow = to_arrow_schema(schema)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, m = Ngrams(), shared.value
        langs = np.array([*m["langs"], NONE], dtype=object)
        for part in _slices(batches):
            counts = grams.counts(part.column("text").to_pylist())
            lettered = counts.any(axis=1)
            cosine = unit(counts, m["idf"]) @ m["centres"].T
            if cosine.shape[1]:
                best = cosine.argmax(axis=1)
                top = np.clip(cosine[np.arange(len(best)), best], 0.0, 1.0).astype(np.float64)
                rejected = ~lettered | (top < reject_below * m["floors"][best, band(counts)] ** 2)
                best = np.where(lettered, best, len(m["langs"]))
            else:
                best, top = np.zeros(len(counts), np.int64), np.zeros(len(counts))
                rejected = ~lettered
            top = np.where(lettered, top, 0.0)
            columns = [part.column(n).cast(arrow.field(n).type) for n in names]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(langs[best].tolist(), pa.string()), pa.array(top), pa.array(rejected)], schema=arrow)

    return text_batches(docs).mapInArrow(predict, schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.filter(~held_out(F.col("doc_id"))))
    named = identify(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return named.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
