"""The stages on the given documents, each against plain Python on its own input, and as a whole."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_jaccard import brute as brute_groups
from test_lines import brute as brute_lines
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from cobaltmill.llm import lines, mixing
from cobaltmill.session import materialise, table


@pytest.fixture(scope="module")
def stored(spark, sf):
    """What goes into each stage, and the last result."""
    docs, out = table(spark, sf, "documents"), []
    for name, stage in pipeline.STAGES:
        out.append(docs)
        docs = materialise(stage(spark, docs, sf), f"test-{name}")
    return [*out, docs]


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_stages(stored, spark, sf):
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "mix", "bpe"]
    columns = table(spark, sf, "documents").columns
    assert all(df.columns == columns for df in stored[:5])


def test_language_id_keeps_clean_documents(stored):
    assert Counter(rows(stored[1])) == Counter(rows(stored[0]))  # all texts here are of a known language


def test_language_id_drops_what_it_rejects(spark, sf):
    docs = table(spark, sf, "documents")
    odd = spark.createDataFrame(
        [(10 ** 6, "12 34", "en", "s", 5), (10 ** 6 + 1, None, "en", "s", 0), (10 ** 6 + 2, "これは日本語の文章です。" * 9, None, "s", 9)],
        docs.schema)
    kept = pipeline.language_id(spark, docs.unionByName(odd), sf)
    assert kept.filter(f"doc_id >= {10 ** 6}").count() == 0 and kept.count() == docs.count()


def test_line_dedup(stored):
    given = {r["doc_id"]: r for r in stored[1].collect()}
    want = brute_lines([(d, r["text"], r["source"]) for d, r in given.items()], lines.MIN_SITES)
    found = {r["doc_id"]: r for r in stored[2].collect()}
    for d, text in want.items():
        if text != given[d]["text"] and not text.strip():
            assert d not in found
        else:
            assert found[d]["text"] == text
            assert found[d]["n_chars"] == (len(text) if text != given[d]["text"] else given[d]["n_chars"])


def test_one_of_each_group_stays(stored):
    groups = brute_groups([(r["doc_id"], r["text"]) for r in stored[2].collect()])
    heads = {c if n else d for d, n, c in groups}
    assert sorted(r["doc_id"] for r in stored[3].collect()) == sorted(heads)
    assert len(heads) < len(groups)


def test_mix_meets_its_targets(stored, spark, sf):
    given = {r["doc_id"]: r for r in stored[3].collect()}
    taken = Counter(r["doc_id"] for r in stored[4].collect())
    mixed = mixing.mix_documents(stored[3], table(spark, sf, "labels")).collect()
    words, goal, longest = defaultdict(int), {}, defaultdict(int)
    for r in mixed:
        assert taken[r["doc_id"]] == r["epochs"] + r["chosen"] <= 2
        words[r["source"]] += taken[r["doc_id"]] * r["size"]
        goal[r["source"]], longest[r["source"]] = r["target"], max(longest[r["source"]], r["size"])
    assert all(abs(words[s] - goal[s]) <= longest[s] / 2 for s in goal)
    assert set(taken) <= set(given)


def test_bpe_and_the_whole_run(stored, spark, sf):
    coder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for r in stored[4].collect():
        ids = coder.encode(r["text"] or "", add_special_tokens=False).ids
        want[(r["doc_id"], len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (
            " ".join(map(str, ids)), coder.decode(ids, skip_special_tokens=False))))] += 1
    assert Counter(rows(stored[5])) == want == Counter(rows(pipeline.run(spark, sf)))


def test_empty_and_odd_documents(spark, no_docs, odd_docs, sf):
    for docs in (no_docs, odd_docs):
        left = docs
        for name, stage in pipeline.STAGES:
            left = materialise(stage(spark, left, sf), f"test-{name}")
        assert left.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        assert (left.count() > 0) == (docs is odd_docs)


def test_copies_on_many_sites_survive_once(spark, sf):
    text = "\n".join(f"line {i} of a page that twenty sites copied with care" for i in range(20))
    docs = spark.createDataFrame([(i, text, "en", f"s{i}", len(text)) for i in range(20)]
                                 + [(50, "a line of its own, on one site", "en", "s0", 30)],
                                 table(spark, sf, "documents").schema)
    cleaned = materialise(pipeline.line_dedup(spark, docs, sf), "test-copies")
    assert {r["doc_id"]: r["text"] == text for r in cleaned.collect()} == {0: True, 50: False}
    assert cleaned.filter(F.col("doc_id") == 50).first()["text"] == "a line of its own, on one site"


def test_near_dedup_takes_five_words_and_four_fifths(stored, spark, sf):
    groups = brute_groups([(r["doc_id"], r["text"]) for r in stored[2].collect()], 80, 5)
    assert sorted(r["doc_id"] for r in stored[3].collect()) == sorted({c if n else d for d, n, c in groups})
    words = [f"w{i}" for i in range(100)]  # two words changed: 86 of 106 runs of five are shared, 89 of 105 of four
    copy = [f"x{i}" if i in (30, 60) else w for i, w in enumerate(words)]
    docs = spark.createDataFrame([(k, " ".join(t), "en", "s", 9) for k, t in ((1, words), (2, copy))],
                                 table(spark, sf, "documents").schema)
    assert [r["doc_id"] for r in pipeline.near_dedup(spark, docs, sf).collect()] == [1]
