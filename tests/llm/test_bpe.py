import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from cobaltmill.llm import bpe
from cobaltmill.session import table

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def theirs():
    found = Tokenizer.from_file(PATH)
    found.no_truncation()
    found.no_padding()
    return found


@pytest.fixture(scope="module")
def ours():
    return bpe.Bpe(bpe.load_vocabulary(PATH))


def texts():
    rnd = random.Random(1)
    out = ["", " \n ", "Hello'LL 123 don't <|endoftext|> x<|startoftext|>y Σίσυφος ÀÉ é \x1c a\x1db 日本語 ½² ١٢",
           "a" * 500, "ab" * 300, "'s's'sx", "<|ENDOFTEXT|> <|endoftext|", "İstanbul ǅ Ω Å ﬁ ſ",
           "x\x85y\xa0z　w​v﻿", "tab\tcr\rff\x0cvt\x0b", "👩‍👩‍👧 👍🏽", "\x00 nul \x7f"]
    out += ["".join(rnd.choice("abcdetrs' <|>/w.éß1\n") for _ in range(300)) for _ in range(200)]
    letters = [*range(0x20, 0x250), *range(0x370, 0x500), *range(0x905, 0x93a), *range(0x4e00, 0x4f00)]
    out += ["".join(chr(rnd.choice(letters)) for _ in range(200)) for _ in range(100)]
    out += [" ".join("".join(rnd.choice(["th", "er", "in", "tion", "a", "s", "e", "o"]) for _ in range(rnd.randrange(1, 9)))
                     for _ in range(60)) for _ in range(100)]
    return out


def test_ids_and_text_equal_the_library(ours, theirs):
    given = texts()
    ids = ours.encode(given)
    decoded = ours.decode(ids).to_pylist()
    for text, found, back in zip(given, ids.to_pylist(), decoded):
        want = theirs.encode(text, add_special_tokens=False).ids
        assert found == want, text
        assert back == theirs.decode(want, skip_special_tokens=False)


def test_speculation_is_verified(ours):
    """Accepted proposals equal exact merging, and some proposals fail."""
    rnd = random.Random(2)
    words = list({"".join(rnd.choice("etaoinshr") for _ in range(rnd.randrange(1, 14))) for _ in range(4000)})
    exact = [ours.merge(w) for w in words]
    assert ours.encode_words(words) == exact
    assert 0 < sum(ours.propose(w) != e for w, e in zip(words, exact)) < len(words)


def test_long_words_take_linear_time(ours, theirs):
    import time

    rnd = random.Random(6)
    for letters in ("acgt", "abcdefghijklmnopqrstuvwxyz", "a"):
        word = "".join(rnd.choice(letters) for _ in range(200_000))
        begun = time.perf_counter()
        found = ours.merge(word)
        assert time.perf_counter() - begun < 10
        assert found == theirs.encode(word, add_special_tokens=False).ids


def test_known_words_are_not_learned_again(monkeypatch, ours):
    """A full cache is only emptied for words that are new; long matches are found letter by letter."""
    texts = ["the quick brown fox", "über straße naïve", "the the zzzzqqq 12"]
    ours.forget()
    first = ours.encode(texts).to_pylist()
    monkeypatch.setattr(bpe, "CACHED_WORDS", len(ours.known) + 1)
    learned = []
    learn = ours.learn
    monkeypatch.setattr(ours, "learn", lambda words: (learned.append(list(words)), learn(words))[1])
    assert ours.encode(texts).to_pylist() == first and not learned
    assert ours.encode(["the newword"]).to_pylist()[0][:1] == first[0][:1] and learned == [["newword"]]
    ours.encode(["one more two"])
    assert learned[-1] == ["one", "more", "two"] and ours.encode(texts).to_pylist() == first


def test_small_cache_gives_the_same(monkeypatch, ours):
    given = texts()[:60]
    want = ours.encode(given).to_pylist()
    monkeypatch.setattr(bpe, "CACHED_WORDS", 10)
    assert [ours.encode([t]).to_pylist()[0] for t in given] == want


def test_decode_odd_ids(ours):
    given = pa.array([[518, 2368], [], None, [518, None, 10 ** 6, -1, 49407]], pa.list_(pa.int32()))
    assert ours.decode(given).to_pylist() == ["the</w> cat</w>", "", "", "the</w> <|endoftext|>"]


def test_whole_table(spark, sf, theirs):
    found = {r["doc_id"]: r for r in bpe.query(spark, sf).collect()}
    rows = table(spark, sf, "documents").collect()
    assert len(found) == len(rows)
    for row in rows:
        ids = theirs.encode(row["text"] or "", add_special_tokens=False).ids
        want = (len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (
            " ".join(map(str, ids)), theirs.decode(ids, skip_special_tokens=False))))
        assert tuple(found[row["doc_id"]])[1:] == want


def test_odd_rows(spark, clashing, no_docs, theirs):
    coded = bpe.round_trip(clashing, PATH)
    assert sorted(coded.columns) == sorted(clashing.columns)
    for r in coded.collect():
        want = theirs.encode(r["text"] or "", add_special_tokens=False).ids
        assert list(r["ids"]) == want
        assert r["decoded"] == theirs.decode(want, skip_special_tokens=False)
    steps = bpe.decode(bpe.encode(clashing.select("doc_id", "text"), PATH), PATH)
    assert sorted(map(str, steps.select("ids", "decoded").collect())) == sorted(
        map(str, coded.select("ids", "decoded").collect()))
    assert bpe.digests(bpe.round_trip(no_docs, PATH)).count() == 0
