"""Harmonise free-text categories against a fixed reference catalog."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cobaltmill.functions import text as T
from cobaltmill.functions import vocab
from cobaltmill.session import materialise

#: The windows that a task of the weighted scorer compares at once.
WINDOWS = 1 << 18


def catalog_key(c: Column) -> Column:
    """The form in which values and terms are compared."""
    return T.strip_accents(T.strip(F.upper(c)))


def levenshtein_match(c: Column, terms: tuple[str, ...]) -> Column:
    """Best term and score; the score is the whole percentage of letters that need no edit."""
    choices = F.array(*[F.lit(t) for t in terms])

    def best(key: Column) -> Column:
        def scored(term: Column, pos: Column) -> Column:
            longest = F.greatest(F.length(key), F.length(term))
            score = F.floor((longest - F.levenshtein(key, term)) * 100 / longest)
            return F.struct(
                score.cast("int").alias("score"), (-pos).alias("earlier"), term.alias("term")
            )

        return F.when(key != "", F.array_max(F.transform(choices, scored)))

    return T.let(catalog_key(c), best)


def _choice(term: str) -> str:
    """A term with its letters' places as bits, in SQL: one literal instead of a call per letter."""
    def text(value: str) -> str:
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"

    places = ", ".join(
        f"{text(letter)}, {sum(1 << i for i, other in enumerate(term) if other == letter)}L"
        for letter in dict.fromkeys(term))
    return f"named_struct('term', {text(term)}, 'bits', {(1 << len(term)) - 1}L, 'places', map({places}))"


def ratio_match(c: Column, terms: tuple[str, ...]) -> Column:
    """Best term and score; the score is the share of letters that stand in common order.

    The longest common subsequence is found with one number per letter: bit ``i`` of the state falls
    once the first ``i + 1`` letters of the term hold one more letter of the common order.
    """
    if max(map(len, terms)) > 62:
        raise ValueError("terms may have 62 letters at most")
    choices = F.expr("array(" + ", ".join(map(_choice, terms)) + ")")

    def best(key: Column) -> Column:
        letters = F.split(key, "")

        def scored(choice: Column, pos: Column) -> Column:
            def step(state: Column, letter: Column) -> Column:
                hit = state.bitwiseAND(F.coalesce(F.try_element_at(choice["places"], letter), F.lit(0).cast("long")))
                return (state + hit).bitwiseOR(state - hit).bitwiseAND(choice["bits"])

            left = F.aggregate(letters, choice["bits"], step)
            common = F.length(choice["term"]) - F.bit_count(left)
            score = F.floor(common * 200 / (F.length(key) + F.length(choice["term"])))
            return F.struct(score.cast("int").alias("score"), (-pos).alias("earlier"), choice["term"].alias("term"))

        return F.when(key != "", F.array_max(F.transform(choices, scored)))

    return T.let(catalog_key(c), best)


class _Weighted:
    """The terms of the weighted scorer: for each its letters' places as bits, and its words' bits and next spaces.

    Texts are compared with a term all at once, one number a text or window. The longest common subsequence
    is found as in ``ratio_match``; a place that a mask leaves out is a letter that never matches.
    """

    def __init__(self, terms: tuple[str, ...]):
        plain = ["".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn").split() for t in terms]
        for term, words in zip(terms, plain):
            if len(set(words)) < len(words) or not words or len(" ".join(words)) > 62:
                raise ValueError(f"term {term!r}: words must differ, and 62 letters are the most")
        self.terms, self.words = terms, [sorted(words) for words in plain]
        self.letters = np.array(sorted({ord(c) for words in plain for c in " ".join(words)}), dtype=np.uint32)
        self.plain = [self._places(" ".join(words)) for words in plain]
        self.sorted = [self._places(" ".join(words)) for words in self.words]
        self.sizes = [len(" ".join(words)) for words in plain]

    def _places(self, text: str) -> np.ndarray:
        """The places of each letter as bits; the last is that of all other letters, which are nowhere."""
        bits = [sum(1 << i for i, c in enumerate(text) if ord(c) == letter) for letter in self.letters]
        return np.array([*bits, 0], dtype=np.uint64)

    def coded(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each length (1 for an empty text) the numbers of the texts and their letters as numbers."""
        sizes = np.array([max(len(t), 1) for t in texts])
        out = []
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            points = np.array([texts[i] for i in at], dtype=f"U{size}").view(np.uint32).reshape(len(at), size)
            spot = np.minimum(np.searchsorted(self.letters, points), len(self.letters) - 1)
            out.append((at, np.where(self.letters[spot] == points, spot, len(self.letters))))
        return out

    def word_sets(self, k: int, words: set[str]) -> float:
        """Compares the words in both and, by letters, the words in one only; some are in both."""
        shared, own = [w for w in self.words[k] if w in words], " ".join(sorted(words.difference(self.words[k])))
        mask, space, at = 0, 0, 0
        for word in self.words[k]:
            if word not in words:
                mask |= space | ((1 << len(word)) - 1) << at
                space = 1 << at + len(word)
            at += len(word) + 1
        s, a, b = len(" ".join(shared)), len(own), mask.bit_count()
        if not a or not b:
            return 100.0
        [(_, codes)] = self.coded([own])
        apart = a + b - 2 * int(_common((self.sorted[k][codes] & np.uint64(mask)).T, self.sizes[k])[0])
        return max(100 - apart * 100 / (2 * s + 2 + a + b), 100 - (a + 1) * 100 / (2 * s + 1 + a),
                   100 - (b + 1) * 100 / (2 * s + 1 + b))

    def best(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each text its best score, and the place of the first term that has it."""
        cut = [re.findall(r"[^ \t\n\x0b\f\r]+", key) for key in keys]
        in_order, once = ([" ".join(sorted(w)) for w in words] for words in (cut, map(set, cut)))
        holders: dict[str, list[int]] = {}
        for i, words in enumerate(cut):
            for word in set(words):
                holders.setdefault(word, []).append(i)
        n, ns, own = (np.array([len(t) for t in texts]) for texts in (keys, in_order, once))
        repeats = np.flatnonzero([a != b for a, b in zip(in_order, once)])
        codes = [self.coded(texts) for texts in (keys, in_order, [once[i] for i in repeats])]
        top, first = np.full(len(keys), -1.0), np.zeros(len(keys), dtype=np.int64)
        for k, m in enumerate(self.sizes):
            long, short = np.maximum(n, m), np.minimum(n, m)
            alike, scale = long * 2 < short * 3, np.where(long <= short * 8, 0.9, 0.6)
            meet = np.zeros(len(keys), dtype=bool)
            meet[[i for word in self.words[k] for i in holders.get(word, ())]] = True
            whole, whole_sorted, whole_once = np.zeros((3, len(keys)), dtype=np.int64)
            plain, moved = np.zeros((2, len(keys)))
            for at, letters in codes[0]:
                whole[at] = _common(self.plain[k][letters].T, m)
                apart = ~alike[at]
                plain[at[apart]] = _windows(self.plain[k][letters[apart]], m)
            for at, letters in codes[1]:
                whole_sorted[at] = whole_once[at] = _common(self.sorted[k][letters].T, m)
                apart = ~alike[at] & ~meet[at]
                moved[at[apart]] = _windows(self.sorted[k][letters[apart]], m)
            for at, letters in codes[2]:
                at = repeats[at]
                whole_once[at] = _common(self.sorted[k][letters].T, m)
                apart = ~alike[at] & ~meet[at]
                moved[at[apart]] = np.maximum(moved[at[apart]], _windows(self.sorted[k][letters[apart]], m))
            by_set = 100 - (own + m - 2 * whole_once) * 100 / (own + m)
            for i in np.flatnonzero(meet & alike):
                by_set[i] = self.word_sets(k, set(cut[i]))
            by_words = np.maximum(whole_sorted * 200 / (np.maximum(ns, 1) + m), by_set) * 0.95
            by_window = np.maximum(plain * scale, np.where(meet, 100.0, moved) * 0.95 * scale)
            score = np.maximum(whole * 200 / (n + m), np.where(alike, by_words, by_window))
            first[score > top] = k
            top = np.maximum(top, score)
        return top, first


def _common(hits: Iterable[np.ndarray], size: int) -> np.ndarray | int:
    """Lengths of the longest common subsequences; ``hits`` are the places of one letter after another."""
    bits = np.uint64((1 << size) - 1)
    state: np.ndarray | np.uint64 = bits
    for hit in hits:
        hit = hit & state
        state = ((state + hit) | (state - hit)) & bits
    return size - np.bitwise_count(state).astype(np.int64)


def _windows(hits: np.ndarray, m: int) -> np.ndarray:
    """The best ratio of the shorter text with a window of its length in the longer; windows may stick out.

    ``hits`` has a row for each text: the places of its letters in the term of ``m`` letters.
    """
    n = hits.shape[1]
    shorter, longer = min(n, m), max(n, m)
    starts = np.arange(1 - shorter, longer)
    low, high = np.maximum(starts, 0), np.minimum(starts + shorter, longer)
    one, out = np.uint64(1), np.zeros(len(hits))
    rows = max(1, WINDOWS // len(starts))
    for at in range(0, len(hits), rows):
        part = hits[at:at + rows]
        found = np.zeros((len(part), len(starts)), dtype=np.int64)
        if n <= m:
            masks = (one << high.astype(np.uint64)) - (one << low.astype(np.uint64))
            found = _common((part[:, j, None] & masks for j in range(n)), m)
        if n >= m:
            wide = np.pad(part, ((0, 0), (m - 1, m - 1)))  # what sticks out matches nowhere
            found = np.maximum(found, _common((wide[:, j:j + len(starts)] for j in range(m)), m))
        out[at:at + rows] = (found * 200 / (shorter + high - low)).max(axis=1)
    return out


def weighted_match(c: Column, terms: tuple[str, ...]) -> Column:
    """Best term and score; the score is the best of several ratios, each with its weight.

    The ratio of the whole texts counts fully. Of texts with like lengths (under 1.5 to 1) the ratio with
    sorted words and that of the word sets count 0.95. Else the best window counts 0.9 (0.6 beyond 8 to 1),
    and the best window with sorted words, or 100 if a word is in both, 0.95 of that. Whole percentages.
    Scored in Arrow batches.
    """
    scorer = _Weighted(terms)

    @F.pandas_udf("score int, earlier int, term string")
    def best(keys: pd.Series) -> pd.DataFrame:
        score, at = scorer.best(keys.fillna("").tolist())
        return pd.DataFrame({"score": np.floor(score).astype(np.int32), "earlier": (-at).astype(np.int32),
                             "term": [terms[k] for k in at]})

    key = catalog_key(c)
    return F.when(key != "", best(key))


SCORERS = {"ratio": ratio_match, "levenshtein": levenshtein_match, "weighted": weighted_match}


def _values(df: DataFrame, column: str, scorer: str) -> DataFrame:
    """The distinct values; for the dearest scorer dealt to all tasks, as few bytes would go to a task or two."""
    values = df.select(column).filter(F.col(column).isNotNull()).distinct()
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return values.repartition(tasks) if scorer == "weighted" else values


def best_terms(df: DataFrame, column: str, catalog: str, scorer: str = "ratio") -> DataFrame:
    """One row per distinct value: its best term and score."""
    match = SCORERS[scorer](F.col(column), vocab.CATALOGS[catalog])
    return _values(df, column, scorer).select(column, match.alias("m")).select(column, "m.term", "m.score")


def harmonize(df: DataFrame, column: str, catalog: str, scorer: str = "ratio",
              threshold: int = vocab.FUZZY_SCORE, values: DataFrame | None = None) -> DataFrame:
    """Replace values that score at least ``threshold`` by their catalog term.

    Each distinct value is scored once. Only matched values are stored and join back, without a
    broadcast hint: their known size decides, and hot values are split in a sort-merge join.
    A stored table of ``values`` that holds those of the column spares computing ``df`` for them;
    nothing is stored then.
    """
    match = SCORERS[scorer](F.col(column), vocab.CATALOGS[catalog])
    good = F.filter(F.array(match), lambda m: m["score"] >= threshold)
    distinct = _values(df if values is None else values, column, scorer)
    # A generator keeps the scoring above the distinct; a plain filter would be pushed below it
    # and score every row.
    matched = distinct.select(column, F.explode_outer(good).alias("m")).filter(F.col("m").isNotNull())
    matched = matched.select(column, "m.term")
    matched = materialise(matched, "matched-terms") if values is None else matched
    joined = df.join(matched, column, "left")
    return joined.withColumn(column, F.coalesce("term", column)).select(*df.columns)
