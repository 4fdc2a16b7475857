import zlib

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from cobaltmill.llm import quality
from cobaltmill.session import materialise, table


def test_held_out_quality(spark, sf):
    """Documents whose label was not used for fitting are judged well."""
    docs = table(spark, sf, "documents")
    labels = table(spark, sf, "labels")
    hidden = F.pmod(F.xxhash64("doc_id", F.lit("hide")), F.lit(3)) == 0
    model = quality.co_train(docs, labels.filter(~hidden))
    found = quality.score(docs, model).join(labels.filter(hidden), "doc_id").select("quality", "keep").collect()
    right = sum(r["keep"] == (r["quality"] == 1) for r in found) / len(found)
    assert len(found) > 10 and right >= 0.9


def test_views_teach_each_other(spark):
    """Few labels, many unlabelled rows: the pool's pseudo-labels reach the other view."""
    def doc(i, good):
        words = " ".join(["calm prose here"] * 4) if good else "LOUD!! NOISE!! HERE!!"
        return (i, f"{words} {i}", "en", "fine" if good else "spam", 100 if good else 5000)

    docs = spark.createDataFrame([doc(i, i % 2 == 0) for i in range(600)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(60)], "doc_id long, quality int")
    model = quality.co_train(docs, labels, rounds=2, grow=50)
    for r in quality.score(docs, model).collect():
        assert r["keep"] == (r["doc_id"] % 2 == 0)
        assert (r["text_score"] > 0.5) == (r["meta_score"] > 0.5) == r["keep"]


def test_scores_follow_the_model(spark, odd_docs):
    rnd = np.random.default_rng(1)
    views = {v: (rnd.normal(size=d), 0.1, 1.5, -0.2) for v, d in (
        ("text", quality.TEXT_DIMS), ("meta", quality.META_DIMS))}
    rows = quality.score(odd_docs, {"prior": 0.8, "views": views}).collect()
    classes = quality.byte_classes()
    for r in rows:
        odds = []
        for view, x in (("text", quality.text_features(r["text"], classes)),
                        ("meta", quality.meta_features(r["source"], r["lang"], r["n_chars"]))):
            w, b, slope, offset = views[view]
            odds.append(slope * (float(x.astype(float) @ w) + b) + offset)
        want = 1 / (1 + np.exp(-(sum(odds) - np.log(0.8 / 0.2))))
        assert abs(r["score"] - want) < 1e-9


def test_odd_rows(spark, clashing, no_docs, labels):
    model = quality.co_train(clashing, labels)  # too few labels to fit
    assert model["views"] is None
    scored = quality.score(clashing, model)
    assert sorted(scored.columns) == sorted([*clashing.columns, "text_score", "meta_score", "keep"])
    assert scored.count() == 16 and {r["score"] for r in scored.collect()} == {model["prior"]}
    assert quality.co_train(no_docs, labels.limit(0))["prior"] == 0.5
    assert quality.score(no_docs, model).count() == 0


def test_every_unlabelled_document_can_teach(spark):
    """The only bad unlabelled documents are last by the hash of the id, behind more than 8000 good ones."""
    ids = spark.range(9000).select("id", F.row_number().over(Window.orderBy(F.xxhash64("id"))).alias("at"))
    bad = F.when(F.col("at") <= 60, F.col("at") % 3 == 0).otherwise(F.col("at") > 8700)
    docs = ids.select(
        F.col("id").alias("doc_id"), F.col("at"), bad.alias("bad"), F.lit("en").alias("lang"), F.lit(100).alias("n_chars"),
        F.concat(F.when(bad, "LOUD!! NOISE!! HERE!! ").otherwise("calm prose here "), F.col("id")).alias("text"),
        F.when(~bad, "fine").when(F.col("at") <= 60, "spam").otherwise("late").alias("source"))
    docs = materialise(docs, "test-late")
    labels = docs.filter("at <= 60").select("doc_id", (~F.col("bad")).cast("int").alias("quality"))
    model = quality.co_train(docs, labels)
    weights = dict(zip(("fine", "spam", "late"), (model["views"]["meta"][0][zlib.crc32(f"source {x}".encode()) % quality.SOURCES]
                                                  for x in ("fine", "spam", "late"))))
    assert weights["late"] < -0.5 < 0 < weights["fine"], weights  # 0 for a source that never taught
    late = quality.score(docs.filter("source = 'late'").limit(5), model).collect()
    assert late and not any(r["keep"] for r in late)
