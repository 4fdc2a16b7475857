"""Document quality by co-training two classifiers that see different things.

The text view sees shares of byte classes and of neighbouring classes, word and line statistics of the
whole text; the metadata view sees source, language and length. Both are logistic regressions, first
fitted on labelled documents. In each round a view's most confident judgements of all unlabelled documents
become training rows of the other view. In the end each view is calibrated on labelled documents that
neither has seen, and the calibrated log-odds are added (the views are taken as independent given the
label). All documents are scored whole, in one pass.

Fitting is bounded: at most ``LABELLED`` labelled documents, those with the smallest hash of the id; one
labelled document in four calibrates. A round moves ``GROW`` documents per view and class, or as many as
are sure. The views of all documents are computed and stored once, and each round scores all that are left.

Defined results:

- null or empty text: all text features 0; null source, language or length: values of their own;
- labels with null id or null quality are ignored; several labels of one document: the smallest counts;
- without both classes among the labels nothing is fitted; all scores are the share of good labels,
  0.5 without any;
- ties in choosing rows go to the smaller hash; repeated rows get equal scores;
- an empty table gives no rows; columns with the names of the results are replaced, others pass.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cobaltmill.llm.common import text_batches
from cobaltmill.llm.shingles import batch_slices
from cobaltmill.operators.ordering import first_n
from cobaltmill.session import materialise, table

LABELLED = 8000
ROUNDS, GROW = 3, 300
SURE = 0.9
SLICE = 1 << 20
CLASSES, PAIRS, STYLES = 48, 208, 7
TEXT_DIMS = CLASSES + PAIRS + STYLES
SOURCES, LANGS, LENGTHS = 64, 16, 24
META_DIMS = SOURCES + LANGS + LENGTHS + 1
VIEWS = ("text", "meta")


def byte_classes() -> np.ndarray:
    """A class per byte: controls, letters, digits, bytes over 127, and each sign on its own."""
    out, signs = np.zeros(256, np.int64), 7
    for b in range(256):
        c = chr(b)
        if b >= 0xC0:
            out[b] = 6
        elif b >= 0x80:
            out[b] = 5
        elif c.isdigit():
            out[b] = 4
        elif c.isalpha():
            out[b] = 3 if c.isupper() else 2
        elif b == 10:
            out[b] = 1
        elif b > 31 and b != 127:
            out[b], signs = signs, signs + 1
    return out % CLASSES


def text_features(text: str | None, classes: np.ndarray) -> np.ndarray:
    out = np.zeros(TEXT_DIMS, np.float32)
    if not text:
        return out
    kind = classes[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)]
    out[:CLASSES] = np.sqrt(np.bincount(kind, minlength=CLASSES) / len(kind))
    pair = (kind[:-1] * CLASSES + kind[1:]) % PAIRS
    out[CLASSES:CLASSES + PAIRS] = np.sqrt(np.bincount(pair, minlength=PAIRS) / len(kind))
    words, lines = text.split(), text.split("\n")
    many = max(len(words), 1)
    out[-STYLES:] = (
        np.log1p(len(text)) / 10, len(text) / many / 10, len(set(words)) / many, len(set(lines)) / len(lines),
        sum(map(str.isupper, words)) / many, np.log1p(len(lines)) / 5, sum(map(str.isalpha, words)) / many)
    return out


def meta_features(source: object, lang: object, n_chars: int | None) -> np.ndarray:
    out = np.zeros(META_DIMS, np.float32)
    out[zlib.crc32(f"source {source}".encode()) % SOURCES] = 1
    out[SOURCES + zlib.crc32(f"lang {lang}".encode()) % LANGS] = 1
    size = 0 if n_chars is None else max(int(n_chars), 0)
    out[SOURCES + LANGS + min(size.bit_length(), LENGTHS - 1)] = 1
    out[-1] = np.log1p(size) / 10
    return out


def _views(part: pa.RecordBatch, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    column = {n: part.column(n).to_pylist() for n in ("text", "source", "lang", "n_chars")}
    text = np.stack([text_features(t, classes) for t in column["text"]])
    return text, np.stack([meta_features(*x) for x in zip(column["source"], column["lang"], column["n_chars"])])


def features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and the views ``text_view`` and ``meta_view`` as arrays."""
    kept = docs.select(*keep, "text", "source", "lang", F.col("n_chars").cast("long").alias("n_chars"))
    schema = T.StructType([*kept.select(*keep).schema.fields, *[
        T.StructField(f"{v}_view", T.ArrayType(T.FloatType())) for v in VIEWS]])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = byte_classes()
        for part in batch_slices(batches, "text", SLICE):
            made = [pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), v.shape[1])
                    for v in _views(part, classes)]
            columns = [*[part.column(n) for n in keep], *made]
            yield pa.RecordBatch.from_arrays(
                [c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return text_batches(kept).mapInArrow(run, schema)


def _fit(rows: DataFrame, view: str) -> tuple[np.ndarray, float]:
    fitted = LogisticRegression(featuresCol="x", labelCol="y", maxIter=25, regParam=0.003).fit(
        rows.select(array_to_vector(f"{view}_view").alias("x"), F.col("good").cast("double").alias("y")))
    return fitted.coefficients.toArray(), float(fitted.intercept)


def _margin(view: str, model: tuple[np.ndarray, float]) -> Column:
    weights, intercept = model
    products = F.zip_with(f"{view}_view", F.lit([float(w) for w in weights]), lambda a, b: a * b)
    return F.aggregate(products, F.lit(intercept), lambda s, p: s + p)


def _sample(docs: DataFrame, labels: DataFrame, labelled: int) -> DataFrame:
    """Views of the labelled rows that fit (good 0/1) and of all unlabelled rows (good null)."""
    judged = materialise(labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(
        (F.min("quality") > 0).cast("int").alias("good")), "quality-judged")
    named = docs.filter("doc_id is not null")
    known = named.select("doc_id").join(judged, "doc_id", "left_semi").distinct().orderBy(
        F.xxhash64("doc_id"), F.col("doc_id")).limit(labelled)
    known = materialise(known.withColumn("_fits", F.lit(True)), "quality-ids")
    marked = features(named, ["doc_id"]).join(judged, "doc_id", "left").join(known, "doc_id", "left")
    return marked.filter("good is null or _fits").drop("_fits")


def _sure(rest: DataFrame, models: dict, grow: int, sure: float) -> DataFrame:
    """``doc_id, view, good``: the documents that each view is most sure of, at most ``grow`` a class."""
    chances = F.array(*[F.struct(F.lit(v).alias("view"), (1 / (1 + F.exp(-_margin(v, models[v])))).alias("p"))
                        for v in VIEWS])
    judged = rest.select("doc_id", F.explode(chances).alias("c")).select(
        "doc_id", "c.*", F.when(F.col("c.p") >= sure, 1).when(F.col("c.p") <= 1 - sure, 0).alias("good"))
    best_first = F.when(F.col("good") == 1, -F.col("p")).otherwise(F.col("p"))
    return first_n(judged.filter("good is not null"), ["view", "good"],
                   [best_first, F.xxhash64("doc_id"), F.col("doc_id")], grow).select("doc_id", "view", "good").distinct()


def co_train(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS, grow: int = GROW,
             sure: float = SURE, labelled: int = LABELLED) -> dict:
    """``prior`` and, for each view, weights, intercept, and the calibration's slope and offset."""
    sample = materialise(_sample(docs, labels, labelled), "quality-sample")
    held = F.pmod(F.xxhash64("doc_id", F.lit("calibrate")), F.lit(4)) == 0
    known = sample.filter("good is not null")
    counts = known.agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"),
                       F.sum(F.when(~held, F.col("good"))).alias("fit_good"),
                       F.count_if(~held).alias("fit"), F.sum(F.when(held, F.col("good"))).alias("held_good"),
                       F.count_if(held).alias("held")).first()
    prior = counts["good"] / counts["n"] if counts["n"] else 0.5
    mixed = all(0 < (counts[g] or 0) < counts[n] for g, n in (("fit_good", "fit"), ("held_good", "held")))
    if not mixed:
        return {"prior": prior, "views": None}
    base = known.filter(~held)
    rest, gained, models = sample.filter("good is null"), {v: None for v in VIEWS}, {}
    for turn in range(rounds + 1):
        for view in VIEWS:
            rows = base if gained[view] is None else base.unionByName(gained[view])
            models[view] = _fit(rows, view)
        if turn == rounds:
            break
        picked = materialise(_sure(rest, models, grow, sure), "quality-picked")
        fresh = materialise(rest.drop("good").join(picked, "doc_id"), "quality-pseudo")
        for view, other in zip(VIEWS, VIEWS[::-1]):
            taught = fresh.filter(F.col("view") == view).drop("view")
            gained[other] = taught if gained[other] is None else gained[other].unionByName(taught)
        rest = rest.join(picked.select("doc_id").distinct(), "doc_id", "left_anti")
    margins = materialise(known.filter(held).select("good", *[
        F.array(_margin(v, models[v]).cast("float")).alias(f"{v}_view") for v in VIEWS]), "quality-margins")
    views = {}
    for view in VIEWS:
        slope, offset = _fit(margins, view)
        views[view] = (*models[view], float(slope[0]), offset)
    return {"prior": prior, "views": views}


def score(docs: DataFrame, model: dict, columns: list[str] | None = None) -> DataFrame:
    """``docs`` with ``text_score, meta_score, score`` (chances of good quality) and ``keep``.

    ``columns`` names those that go on (all by default).
    """
    made = ["text_score", "meta_score", "score"]
    docs = docs.drop(*made, "keep")
    names = docs.columns if columns is None else columns
    schema = T.StructType([*[docs.schema[n] for n in names], *[T.StructField(n, T.DoubleType()) for n in made]])
    arrow = to_arrow_schema(schema)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def chance(x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x, -500, 500)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, m = byte_classes(), shared.value
        prior = min(max(m["prior"], 1e-6), 1 - 1e-6)
        for part in batch_slices(batches, "text", SLICE):
            if m["views"] is None:
                scores = [np.full(part.num_rows, m["prior"])] * 3
            else:
                odds = []
                for view, x in zip(VIEWS, _views(part, classes)):
                    weights, intercept, slope, offset = m["views"][view]
                    odds.append(slope * (x.astype(np.float64) @ weights + intercept) + offset)
                both = odds[0] + odds[1] - np.log(prior / (1 - prior))
                scores = [chance(odds[0]), chance(odds[1]), chance(both)]
            columns = [part.column(n).cast(arrow.field(n).type) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, scores)], schema=arrow)

    return text_batches(docs).mapInArrow(run, schema).withColumn("keep", F.col("score") >= 0.5)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    model = co_train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model, ["doc_id"]).select("doc_id", "text_score", "meta_score", "score", "keep")
