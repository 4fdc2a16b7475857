import random
from pathlib import Path
import re

import numpy as np
import pytest

from cobaltmill.llm import jaccard
from cobaltmill.llm.shingles import shingle_sets, word_hashes

WORDS = re.compile("[^\x20\x09-\x0d]+")


def sets_of(text, width=4):
    lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = WORDS.findall(lowered)
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)}


def brute(rows, percent=85, width=4):
    sets = [sets_of(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def run(spark, rows, **how):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((tuple(r) for r in jaccard.components(docs, **how).collect()), key=str)


def edited(rnd, words, edits):
    words = list(words)
    for _ in range(edits):
        at = rnd.randrange(len(words))
        kind = rnd.random()
        if kind < .4:
            words[at] = f"new{rnd.randrange(10 ** 6)}"
        elif kind < .7 and len(words) > 5:
            del words[at]
        else:
            words.insert(at, f"ins{rnd.randrange(10 ** 6)}")
    return words


def corpus(seed):
    """Groups of near copies at all sizes around the threshold, chains, shared passages, short texts."""
    rnd = random.Random(seed)
    rows, d = [], 0
    vocabulary = [f"v{i}" for i in range(400)]
    shared = [rnd.choices(vocabulary, k=12) for _ in range(4)]
    for size in (4, 5, 7, 9, 12, 17, 25, 40, 60, 90, 150, 300, 700):
        for _ in range(3):
            base = rnd.choices(vocabulary, k=size)
            for _ in range(rnd.randrange(2, 6)):
                rows.append((d, " ".join(edited(rnd, base, rnd.randrange(0, max(2, size // 40 + 2)))))); d += 1
        chain = rnd.choices(vocabulary, k=size)
        for _ in range(5):
            chain = edited(rnd, chain, max(1, size // 60))
            rows.append((d, "  ".join(chain).upper())); d += 1
        for passage in shared:
            rows.append((d, " ".join(passage + rnd.choices(vocabulary, k=size)))); d += 1
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,percent,width", [(1, 85, 4), (2, 80, 5), (3, 60, 2)])
def test_all_links_are_found(spark, seed, percent, width):
    rows = corpus(seed)
    assert run(spark, rows, percent=percent, width=width) == brute(rows, percent, width)


def test_large_group_of_near_copies(spark):
    rnd = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    rows = [(i, " ".join(edited(rnd, base, rnd.randrange(0, 6)))) for i in range(260)]
    assert run(spark, rows) == brute(rows)


def test_odd_rows(spark, clashing, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in clashing.select("doc_id", "text").collect()]
    found = sorted((tuple(r) for r in jaccard.components(clashing).collect()), key=str)
    assert found == brute(rows)
    assert jaccard.components(no_docs).count() == 0
    kept = jaccard.near_dedup(clashing)
    assert kept.columns == clashing.columns
    ids = sorted((r["doc_id"] for r in kept.select("doc_id").collect()), key=str)
    # 5, 6, 6, 7 and one row without id are copies of each other
    assert ids == sorted([1, 2, 3, 4, 5, 8, 8, 9, 10, 11, 12, None], key=str)


def test_rows_without_ids(spark):
    """Different texts without ids all stay; a copy of a named text goes, of unnamed copies one stays."""
    text = "one two three four five six seven eight"
    rows = [(None, "first of the unnamed texts here"), (None, "second one of the unnamed"), (None, text), (7, text.upper()),
            (None, "third of the unnamed texts is twice"), (None, "third of the unnamed texts is twice"),
            (9, "nine has one text here"), (9, "and nine has another text there"), (9, "nine has one text here")]
    kept = jaccard.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(set(rows) - {(None, text)}, key=str)


def test_common_passages_make_no_pairs(spark, monkeypatch):
    """Texts that share most of their words but aren't near copies don't all meet, and no link is lost."""
    rnd = random.Random(11)
    passage = [f"p{i}" for i in range(140)]
    rows = [(i, " ".join(passage + [f"u{rnd.randrange(10 ** 7)}" for _ in range(60)])) for i in range(150)]
    near = rows[3][1].split()
    rows += [(200, " ".join(edited(rnd, near, 3))), (201, " ".join(near[:-4])), (202, " ".join(passage))]
    sizes = []
    test = jaccard._Links.test

    def counted(self, pairs):
        sizes.append(pairs.count())
        return test(self, pairs)

    monkeypatch.setattr(jaccard._Links, "test", counted)
    assert run(spark, rows) == brute(rows)
    assert sum(sizes) < 3 * 80 * len(rows) and sizes[-1] < 300


def test_stored_tables_go_early_and_only_new_links_are_connected(spark, monkeypatch):
    """At the end only the result's tables are left; later rounds connect the roots that new links meet."""
    from cobaltmill.session import fresh_path

    rnd = random.Random(5)
    rows = []
    for group in range(12):
        words = [f"g{group}w{i}" for i in range(120)]
        for i in range(20):
            words = edited(rnd, words, 2)
            rows.append((len(rows), " ".join(words)))
    edges = []
    connected = jaccard.connected

    def counted(pairs, tag="components"):
        edges.append(pairs.count())
        return connected(pairs, tag)

    monkeypatch.setattr(jaccard, "connected", counted)
    folder = Path(fresh_path(spark, "x").removeprefix("file:")).parent
    before = set(folder.iterdir()) if folder.exists() else set()
    assert run(spark, rows) == brute(rows)
    left = sorted(p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - before)
    assert left == ["near-least", "near-rooted"]
    assert len(edges) > 1 and sum(edges[1:]) < edges[0]


def test_near_dedup_leaves_only_its_heads_and_one_of_repeated_rows(spark):
    from cobaltmill.session import fresh_path

    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words))] * 3 + [(2, " ".join(words))] * 2 + [(None, "x y"), (None, "x y"), (4, None), (4, None), (5, "p q r s")]
    folder = Path(fresh_path(spark, "x").removeprefix("file:")).parent
    before = set(folder.iterdir()) if folder.exists() else set()
    kept = jaccard.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - before] == ["near-heads"]
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(
        [rows[0], (None, "x y"), (4, None), (4, None), (5, "p q r s")], key=str)


@pytest.mark.parametrize("percent,width", [(85, 4), (80, 5), (60, 2)])
def test_token_property(percent, width):
    """Linked sets share one of their D + 1 rarest tokens, whatever the order, and have equally many."""
    rnd = random.Random(10)
    spans = jaccard.windows(percent)
    tried = 0
    for size in [*range(3, 30), 60, 150, 400]:
        for _ in range(60):
            base = [f"t{rnd.randrange(10 ** 6)}" for _ in range(size)]
            x, y = shingle_sets([" ".join(base), " ".join(edited(rnd, base, rnd.randrange(1, size // 30 + 2)))], width)
            both = len(set(x) & set(y))
            if 100 * both < percent * (len(x) + len(y) - both):
                continue
            tried += 1
            tokens = [{n: (need, t) for n, need, t in jaccard.block_tokens(s, percent, spans)} for s in (x, y)]
            met = False
            for n in tokens[0].keys() & tokens[1].keys():
                assert len(tokens[0][n][1]) == len(tokens[1][n][1])
                rare = [sorted(t.tolist(), key=lambda v: (v * 7919 % 10007, v))[:need] for need, t in (tokens[0][n], tokens[1][n])]
                met |= bool(set(rare[0]) & set(rare[1]))
            assert met
    assert tried > 100


def test_key_property():
    """Two linked sets share a key unless they are equal."""
    rnd = random.Random(9)
    spans = jaccard.windows(85)
    texts = []
    for size in [*range(4, 40), 60, 100, 200, 500, 900]:
        for _ in range(40):
            base = [f"t{rnd.randrange(10 ** 6)}" for _ in range(size)]
            texts.append((" ".join(base), " ".join(edited(rnd, base, rnd.randrange(1, size // 30 + 2)))))
    tried = 0
    for a, b in texts:
        x, y = shingle_sets([a, b], 4)
        both = len(set(x) & set(y))
        if 100 * both >= 85 * (len(x) + len(y) - both):
            tried += 1
            keys = [set().union(*map(list, jaccard.block_keys(s, 85, spans))) for s in (x, y)]
            assert keys[0] & keys[1]
    assert tried > 100


@pytest.mark.parametrize("percent,width", [(85, 4), (80, 5)])
def test_most_sets_emit_d_plus_one_keys_a_window(percent, width):
    rnd = random.Random(12)
    spans, over = jaccard.windows(percent), 0
    sizes = [rnd.randrange(150, 1500) for _ in range(200)]
    for found in shingle_sets([" ".join(f"t{rnd.randrange(10 ** 8)}" for _ in range(n)) for n in sizes], width):
        n = len(found)
        need = sum(jaccard.most_apart(n, min(high, n * 100 // percent), percent) + 1 for low, high in spans if low <= n <= high)
        over += sum(map(len, jaccard.block_keys(found, percent, spans))) > need
    assert over < 40


def test_one_common_sentence_opens_no_large_groups(spark, monkeypatch):
    """A lone shingle of a sentence that all texts hold is no key, so few texts need their tokens."""
    rnd = random.Random(13)
    common = " ".join(f"c{i}" for i in range(8))
    rows = [(i, " ".join([*(f"u{rnd.randrange(10 ** 8)}" for _ in range(400)), common])) for i in range(800)]
    asked = []
    refined = jaccard._Links.refined

    def counted(self, open_nodes):
        asked.append(open_nodes.count())
        return refined(self, open_nodes)

    monkeypatch.setattr(jaccard._Links, "refined", counted)
    assert all(d == c for d, _, c in run(spark, rows, percent=80, width=5))
    assert sum(asked) < 80


def test_far_pairs_of_long_texts_are_not_read(spark, monkeypatch):
    """Parity bits grow with the sets: long texts with a common passage are told apart without their words."""
    rnd = random.Random(14)
    passage = [f"p{i}" for i in range(900)]
    rows = [(i, " ".join(passage + [f"u{rnd.randrange(10 ** 8)}" for _ in range(900)])) for i in range(12)]
    tested, read = [], []
    test, texts = jaccard._Links.test, jaccard._Links.texts

    def counted(self, pairs):
        tested.append(pairs.count())
        return test(self, pairs)

    def noted(self, asked):
        read.append(asked.count())
        return texts(self, asked)

    monkeypatch.setattr(jaccard._Links, "test", counted)
    monkeypatch.setattr(jaccard._Links, "texts", noted)
    assert run(spark, rows) == brute(rows)
    assert sum(tested) > 10 and not read


@pytest.mark.parametrize("percent", [85, 80, 30])
def test_wide_parity_bits_lose_no_link(spark, percent):
    """Also of sets whose numbers of bits differ; unlike sets are told apart."""
    rnd = random.Random(15)
    rows = []
    for size in (40, 300, 390, 400, 470, 590, 800, 1200, 1700, 2300, 3000):
        base = [rnd.getrandbits(64) for _ in range(size)]
        for share in (1, .99, .95, .9, .86, .8, .4):
            other = base[:int(size * share)] + [rnd.getrandbits(64) for _ in range(int(size * (1 - share) / 9))]
            for y in (other, [rnd.getrandbits(64) for _ in other]):
                x, y = np.array(base, np.uint64), np.array(y, np.uint64)
                both = len(set(x.tolist()) & set(y.tolist()))
                bits = [jaccard.wide_parity(s, percent).tolist() for s in (x, y)]
                rows.append((len(x), len(y), *bits, 100 * both >= percent * (len(x) + len(y) - both), both))
    found = spark.createDataFrame(rows, "an int, bn int, awide array<long>, bwide array<long>, linked boolean, both int").select(
        "*", jaccard._far_wide("a", "b", percent).alias("far")).collect()
    assert not [r for r in found if r["linked"] and r["far"]] and sum(r["linked"] for r in found) > 20
    assert any(0 < len(r["awide"]) != len(r["bwide"]) > 0 for r in found if r["linked"])
    assert all(r["far"] for r in found if not r["both"] and min(len(r["awide"]), len(r["bwide"])))


@pytest.mark.parametrize("percent", [50, 80, 85, 99, 100])
def test_windows_cover_all_pairs(percent):
    spans = jaccard.windows(percent)
    for a in range(1, 400):
        for b in range(a, a * 100 // percent + 1):
            assert any(low <= a and b <= high for low, high in spans), (a, b)


def test_words_and_shingles_match_plain_python():
    texts = ["A b\tC\x0bd", "", None, "  ", "x", "Ünï ä\x85b c d", "a b c d e a b c d e"]
    hashes, owner = word_hashes(texts)
    assert [int((owner == i).sum()) for i in range(len(texts))] == [len(WORDS.findall(t or "")) for t in texts]
    assert [len(s) for s in shingle_sets(texts, 4)] == [len(sets_of(t)) for t in texts]
    same = shingle_sets(["HELLO you there my friend", "hello YOU there my friend"], 4)
    assert (same[0] == same[1]).all()
