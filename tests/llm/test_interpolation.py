import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cobaltmill.llm import interpolation as lm

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)) + ["</s>"]


class Model:
    """The same model with dictionaries: a gram that reaches over the start begins with None, once."""

    def __init__(self, texts, order):
        self.order, self.docs = order, len(texts)
        self.seen = [Counter() for _ in range(order)]
        for words in texts:
            for i in range(len(words)):
                for k in range(order):
                    self.seen[k][self.gram(words, i, k)] += 1
        self.n, self.v = sum(self.seen[0].values()), len(self.seen[0])

    @staticmethod
    def gram(words, i, k):
        return tuple(words[i - k:i + 1]) if i >= k else (None, *words[:i + 1])

    def context(self, words, i, k):
        if k == 0:
            return self.n
        if i == 0:
            return self.docs
        return self.seen[k - 1][self.gram(words, i - 1, k - 1)]

    def estimates(self, words, i):
        p, bucket = [1 / (self.v + 1)], 0
        for k in range(self.order):
            c = self.context(words, i, k)
            p.append(self.seen[k][self.gram(words, i, k)] / c if c else 0)
            if k and c:
                bucket = 64 * k + int(math.log2(c))
        return p, bucket


def learn(kept, held, order):
    model = Model(kept, order)
    rows = [model.estimates(words, i) for words in held for i in range(len(words))]
    weights = {b: [1 / (b // 64 + 2) if k <= b // 64 + 1 else 0.0 for k in range(order + 1)] for _, b in rows}
    last = None
    for _ in range(lm.ROUNDS):
        if not rows:
            break
        mass, fit = defaultdict(lambda: [0.0] * (order + 1)), 0.0
        for p, b in rows:
            whole = sum(w * x for w, x in zip(weights[b], p))
            fit += math.log(whole)
            mass[b] = [m + w * x / whole for m, w, x in zip(mass[b], weights[b], p)]
        for b, m in mass.items():
            m = [x + 1 if k < b // 64 + 2 else 0.0 for k, x in enumerate(m)]
            weights[b] = [x / sum(m) for x in m]
        fit /= len(rows)
        if last is not None and fit - last < lm.GAIN:
            break
        last = fit
    return weights


def brute(rows, held_share, held_out, order):
    texts = [(i, tokens(t)) for i, t in rows]
    model = Model([w for i, w in texts if not held_out(i)], order)
    weights = learn([w for i, w in texts if not held_out(i) and not held_share(i)],
                    [w for i, w in texts if not held_out(i) and held_share(i)], order)
    out = []
    for i, words in texts:
        score = base = 0.0
        for at in range(len(words)):
            p, b = model.estimates(words, at)
            near = [x for x in weights if x // 64 == b // 64]
            able = b // 64 + 2
            w = weights[min(near, key=lambda x: (abs(x - b), x))] if near else [1 / able] * able
            score += math.log10(sum(a * x for a, x in zip(w, p)))
            base += math.log10((model.seen[0][(words[at],)] + .5) / (model.n + .5 * (model.v + 1)))
        out.append((i, held_out(i), len(words), sum(model.seen[0][(x,)] > 0 for x in words), model.n, base, score))
    return sorted(out, key=str)


def close(found, want):
    assert len(found) == len(want)
    for a, b in zip(found, want):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], rel=1e-9)


def run(docs, order=3, grams=lm.RANGE, **sizes):
    names = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    found = lm.score_chunks(lm.chunks(docs, lm.is_held_out(F.col("doc_id")), **sizes), order, grams).collect()
    return sorted((tuple(r[n] for n in names) for r in found), key=str)


def shares(spark, ids, held_of):
    rows = spark.createDataFrame([(i,) for i in ids], "doc_id long").select(
        "doc_id", lm.is_held_out(F.col("doc_id")), F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(held_of)) == 0).collect()
    out, share = {r[0]: r[1] for r in rows}, {r[0]: r[2] for r in rows}
    return share.__getitem__, out.__getitem__


def sentences(n, seed=2):
    rnd = random.Random(seed)
    follow = {w: [rnd.randrange(60) for _ in range(4)] for w in range(60)}
    out = []
    for i in range(n):
        w, words = rnd.randrange(60), []
        for _ in range(rnd.randint(0, 40)):
            words.append(("W" if rnd.random() < .3 else "w") + str(w) if rnd.random() < .97 else f"x{rnd.randrange(10 ** 6)}")
            w = rnd.choice(follow[w])
        out.append((i, " ".join(words)))
    return out


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_equals_a_plain_model(spark, order):
    rows = sentences(300)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows, *shares(spark, [i for i, _ in rows], 4), order)
    close(run(docs, order, grams=2000, held_of=4, limit=400, size=700), want)


def test_odd_rows(spark, odd_docs, clashing):
    rows = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    want = brute(rows, *shares(spark, {i for i, _ in rows}, 3), 3)
    close(run(odd_docs, held_of=3), want)
    close(run(clashing, held_of=3), want)


def test_all_held_out_or_none(spark):
    rows = [(i, "a b a c") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    never, always = lm.score(docs, F.lit(False)).collect(), lm.score(docs, F.lit(True)).collect()
    assert len(never) == len(always) == 30
    assert all(r["train_tokens"] == 150 and r["n_known"] == 5 for r in never)
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["base_score"] == 0 for r in always)
    assert all(math.isfinite(r["score"]) and r["score"] <= 0 for r in [*never, *always])


def test_empty(spark, no_docs):
    assert run(no_docs) == []


def test_better_than_the_base(spark, sf):
    found = lm.query(spark, sf).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert found[0] > 1.2 * found[1]


def test_squeeze_round_trip():
    import numpy as np
    for values in ([], [0], [1, 2, 300], [2 ** 64 - 1, 0, 7], list(range(1000))):
        a = np.array(values, dtype=np.uint64)
        assert lm._restore(lm._squeeze(a)).tolist() == values
