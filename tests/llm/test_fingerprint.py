import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from cobaltmill.llm import fingerprint as fp
from cobaltmill.session import table

CUT = re.compile(r"(?<=\n)|(?<=[.!?] )")


def spark_hash(seed, text):
    """Spark's xxhash64 of an int and a string."""
    first = xxhash.xxh64_intdigest(seed.to_bytes(4, "little"), 42)
    return xxhash.xxh64_intdigest(text.encode(), first)


def sums(text):
    items = [p.strip(" \t\r\n") for p in CUT.split(text or "")]
    items = [p for p in items if p]
    out = [len(items)]
    for seed in range(fp.SEEDS):
        for skip in (0, 24):
            total = 0
            for p in items:
                h = spark_hash(seed, p) >> skip
                total += sum((h >> 8 * k & 255) << fp.SLOT * k for k in range(3))
            out.append(total & fp.MODULUS)
    return out


def near(a, b):
    if a == b:
        return 1.0

    def lanes(s):
        size = 1 << fp.SLOT
        return [((2 * (x >> fp.SLOT * k & size - 1) - 255 * s[0] + size) % (2 * size)) - size
                for x in s[1:] for k in range(3)]

    x, y = lanes(a), lanes(b)
    norm = (sum(p * p for p in x) * sum(p * p for p in y)) ** 0.5
    return min(max(sum(p * q for p, q in zip(x, y)) / norm, 0.0), 1.0) if norm else 0.0


def brute(rows):
    """rows (doc_id, text) with distinct ids."""
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: -r[0])
    out = {}
    for (d, x), (_, y) in zip(rows, rows[1:] + rows[:1]):
        f = len(x) // 2
        edited = x[:len(x) - f] + y[:f]
        a, b, c = sums(x), sums(edited), sums(y)
        text = ["".join(f"{v:015x}" for v in s) for s in (a, b)]
        out[d] = (len(x), hashlib.sha256(edited.encode()).hexdigest(), *text, near(a, b), near(a, c))
    return out


def test_whole_table(spark, sf):
    docs = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    want = brute(docs)
    found = fp.query(spark, sf).collect()
    assert len(found) == len(docs)
    for r in found:
        assert tuple(r)[1:5] == want[r["doc_id"]][:4]
        assert tuple(r)[5:7] == pytest.approx(want[r["doc_id"]][4:])


def test_insert_and_delete_in_any_order(spark):
    rnd = random.Random(4)
    parts = [f"paragraph {i} says {rnd.random()}" for i in range(50)] * 2
    shuffled = rnd.sample(parts, len(parts))
    rows = [("\n".join(parts), "\n".join(shuffled), "\n".join(parts[:30]), "\n".join(parts[30:]))]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string")
    for c in "abcd":
        df = fp.fingerprints(df, F.col(c), f"s{c}")
    r = df.select("sa", "sb", fp.insert(F.col("sc"), F.col("sd")).alias("both"),
                  fp.delete(F.col("sa"), F.col("sd")).alias("less"), "sc").first()
    assert r["sa"] == r["sb"] == r["both"] and r["less"] == r["sc"]


def test_likeness_follows_shared_paragraphs(spark):
    rnd = random.Random(6)
    pool = [f"paragraph number {i} {rnd.random()}" for i in range(400)]
    rows = [(k, "\n".join(pool[:100]), "\n".join(pool[100 - k:200 - k])) for k in (0, 25, 50, 75, 100)]
    df = spark.createDataFrame(rows, "k int, a string, b string")
    df = fp.fingerprints(fp.fingerprints(df, F.col("a"), "sa"), F.col("b"), "sb")
    found = {r["k"]: r["near"] for r in fp.likeness(df, "sa", "sb", "near").collect()}
    assert found[100] == 1.0 and all(abs(found[k] - k / 100) < 3 / fp.LANES ** 0.5 for k in found)


def test_odd_rows(spark, clashing, no_docs):
    rows = fp.edit_with_next(clashing).collect()
    assert len(rows) == 16
    order = sorted((r for r in rows if r["doc_id"] is not None), key=lambda r: -r["doc_id"])
    assert {r["n_chars"] for r in rows if r["doc_id"] in (2, 3)} == {0}
    texts = {}
    for r in clashing.select("doc_id", "text").collect():
        texts.setdefault(r["doc_id"], []).append(r["text"] or "")
    for r in order:
        f = r["n_chars"] // 2
        assert r["text"] in texts[r["doc_id"]]
        assert any(r["edited"] == r["text"][:len(r["text"]) - f] + t[:f] for t in texts[r["next_id"]])
    # equal rows follow each other, and the last id is followed by the rows without id
    sixes = sorted(r["next_id"] for r in rows if r["doc_id"] == 6)
    assert sixes == [5, 6]
    assert [r["next_id"] for r in rows if r["doc_id"] == 1] == [None]
    assert 12 in [r["next_id"] for r in rows if r["doc_id"] is None]
    assert fp.edit_with_next(no_docs).count() == 0
    one = spark.createDataFrame([(5, "abcd")], "doc_id long, text string")
    assert fp.edit_with_next(one).first()["edited"] == "abab"


def test_plan_has_no_python(spark, odd_docs):
    plan = fp.edit_with_next(odd_docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
