import math
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from cobaltmill.llm import langid
from cobaltmill.session import table


def test_held_out_accuracy(spark, sf):
    found = langid.query(spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in found if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found)
    assert held and sum(r["lang_pred"] == r["lang"] for r in held) / len(held) >= 0.95
    assert not any(r["rejected"] for r in found)
    assert all(0 <= r["score"] <= 1 for r in found)


def test_predictions_are_the_nearest_centroid(spark, sf):
    """Against plain Python with dictionaries instead of numpy."""
    docs = table(spark, sf, "documents")
    model = langid.learn(docs.filter(~langid.held_out(F.col("doc_id"))))
    rows = langid.identify(docs.limit(25).select("doc_id", "text"), model).collect()
    for r in rows:
        letters = "".join(c if c.isalpha() else " " for c in r["text"].lower())
        line = " " + " ".join(letters.split()) + " "
        counts = Counter()
        for n, by in enumerate(langid.MULTIPLIERS):
            for i in range(len(line) - n):
                h = 0
                for k in range(n + 1):
                    h = (h + ord(line[i + k])) * langid.MULTIPLIERS[k] % 2 ** 32
                h = ((h ^ h >> 15) * 0x2C1B3C6D % 2 ** 32) >> 20
                counts[h] += 1
        weight = {d: math.log1p(c) * float(model["idf"][d]) for d, c in counts.items()}
        norm = math.sqrt(sum(w * w for w in weight.values()))
        cosine = [sum(w * c[d] for d, w in weight.items()) / norm for c in model["centres"]]
        assert abs(max(cosine) - r["score"]) < 1e-4
        assert r["lang_pred"] == model["langs"][int(np.argmax(cosine))]


def test_odd_rows(spark, clashing, no_docs):
    model = langid.learn(clashing)
    named = langid.identify(clashing, model)
    assert sorted(named.columns) == sorted([*clashing.columns, "lang_pred", "rejected"])
    rows = {r["doc_id"]: r for r in named.collect()}
    for i in (2, 3, 4, 11):
        assert (rows[i]["lang_pred"], rows[i]["score"], rows[i]["rejected"]) == ("und", 0.0, True), i
    assert rows[5]["lang_pred"] == "en" and rows[10]["lang_pred"] == "fr"
    assert named.count() == 16
    assert langid.identify(no_docs, model).count() == 0
    blank = langid.identify(clashing, langid.learn(no_docs))
    got = {r["doc_id"]: r for r in blank.collect()}
    assert (got[5]["lang_pred"], got[5]["score"], got[5]["rejected"]) == ("und", 0.0, False)
    assert got[11]["rejected"]


def test_foreign_text_is_rejected(spark, sf):
    docs = table(spark, sf, "documents")
    model = langid.learn(docs)
    other = spark.createDataFrame(
        [(1, "これは日本語の文章です。" * 5), (2, "Это предложение на русском языке " * 3)], "doc_id long, text string")
    assert all(r["rejected"] for r in langid.identify(other, model).collect())


def test_sample_is_bounded(spark):
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id")).alias("text"),
        F.when(F.col("id") % 100 == 0, "xx").otherwise("en").alias("lang"))
    model = langid.learn(docs, per_lang=50)
    assert sorted(set(model["langs"])) == ["en", "xx"]
    texts, seen = langid.document_frequency(docs)
    assert texts == 3000 and seen.max() == 3000


def test_foreign_and_junk_texts_of_any_length_are_rejected(spark, sf):
    """Also with an odd member in a language, and without losing a clean document."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    rnd = random.Random(5)
    scripts = ["абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω", "".join(map(chr, range(0x4E00, 0x5A00))),
               "abcdefghijklmnopqrstuvwxyz"]
    texts = [" ".join("".join(rnd.choices(s, k=rnd.randrange(3, 9))) for _ in range(n))
             for s in scripts for n in (500, 2000, 10000)]
    odd = spark.createDataFrame([(10 ** 6, "zq xv " * 30 + " ".join("ЖЩ" + "Ю" * i for i in range(300)), "en")], docs.schema)
    given = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for known in (docs, docs.unionByName(odd)):
        model = langid.learn(known, per_lang=10 ** 6)
        assert langid.identify(given, model).filter("not rejected").count() == 0
        assert langid.identify(docs, model).filter("rejected").count() == 0
