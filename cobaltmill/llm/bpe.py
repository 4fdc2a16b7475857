"""Byte-pair encoding and decoding of whole texts by speculation and verification.

For the distinct words of a slice of texts, the longest vocabulary entries from the left are the
proposed tokens. A proposal is the exact result of merging if every token is what merging makes of
its own characters and no merge crosses a boundary between two neighbours. The second test walks
back through the merges of both neighbours, for all distinct neighbouring pairs at once in numpy.
Words that fail are merged exactly, pair by pair.

The vocabulary is a file of the ``tokenizers`` library (byte-level BPE with a word-end suffix, NFC
and lower case, white space dropped); its path is a parameter, the driver reads it once and sends it
to the workers. Special tokens found in a text become their ids, as that library does.

Defined results:

- null or empty text, or one of white space only: no ids, decoded to the empty text;
- decoding joins the entries of the ids with a space (the file names no decoder); unknown or null ids
  are left out, a null list gives the empty text;
- long texts are encoded whole, words of any length among them;
- repeated rows are encoded alike; an empty table gives no rows;
- other columns pass through; columns named ``ids`` or ``decoded`` are replaced.
"""

from __future__ import annotations

import itertools
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cobaltmill.llm.common import text_batches
from cobaltmill.llm.shingles import batch_slices
from cobaltmill.session import table

SLICE = 2 << 20
CACHED_WORDS = 400_000
#: In place of a piece that was merged into its left neighbour.
GONE = -1
#: White space of the vocabulary's patterns (fixed values).
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: How a text falls into words (fixed value of the vocabulary file), and the same for ASCII texts.
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+"
ASCII_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+"


def load_vocabulary(path: str) -> dict:
    """What the workers need of a vocabulary file."""
    with open(path, encoding="utf-8") as file:
        whole = json.load(file)
    model = whole["model"]
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    return {"vocab": model["vocab"], "merges": merges, "suffix": model["end_of_word_suffix"] or "",
            "special": {t["content"]: t["id"] for t in whole["added_tokens"]}}


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte: itself, or the next free one from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = itertools.count(256)
    return {b: chr(b) if b in plain else chr(next(free)) for b in range(256)}


class Bpe:
    """Merging tables of one vocabulary and the chunks already encoded."""

    def __init__(self, spec: dict):
        self.vocab, self.suffix, self.special = spec["vocab"], spec["suffix"], spec["special"]
        size = max([*self.vocab.values(), *self.special.values()]) + 1
        self.size = size
        entries = [None] * size
        for word, i in [*self.vocab.items(), *self.special.items()]:
            entries[i] = word
        self.entries = pa.array(entries, pa.string())
        self.rank = np.full(size, -1, dtype=np.int64)
        self.left = np.full(size, -1, dtype=np.int64)
        self.right = np.full(size, -1, dtype=np.int64)
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        self.sound = np.ones(size, dtype=bool)
        for r, (x, y) in enumerate(spec["merges"]):
            a, b, made = self.vocab[x], self.vocab[y], self.vocab[x + y]
            if (a, b) in self.ranks:
                continue
            self.ranks[a, b] = (r, made)
            if self.rank[made] >= 0 or max(self.rank[a], self.rank[b]) >= r:
                self.sound[made] = False  # two ways to make it, or made before its parts
            else:
                self.rank[made], self.left[made], self.right[made] = r, a, b
        keys = np.array([a * size + b for a, b in self.ranks], dtype=np.int64)
        values = np.array([r for r, _ in self.ranks.values()], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        merged = np.flatnonzero(self.rank >= 0)
        merged = merged[np.argsort(self.rank[merged])]
        self.sound[merged] &= self.apart(self.left[merged], self.right[merged], skip_first=True)
        for t in merged:
            self.sound[t] &= self.sound[self.left[t]] and self.sound[self.right[t]]
        #: The entries as a tree of letters; ``""`` holds the id of the entry that ends there, ``None`` that of a word's end.
        self.tree: dict = {}
        for word, i in self.vocab.items():
            ends = bool(self.suffix) and word.endswith(self.suffix)
            at = self.tree
            for letter in word.removesuffix(self.suffix) if ends else word:
                at = at.setdefault(letter, {})
            at[None if ends else ""] = i
        letters = byte_letters()
        self.letters = {b: c for b, c in letters.items() if chr(b) != c}
        self.words = regex.compile(WORDS)
        self.ascii_words = re.compile(ASCII_WORDS)
        self.split_special = re.compile("(" + "|".join(
            re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")
        self.forget()

    def forget(self) -> None:
        """Begin with special tokens only: words get numbers in turn, and their ids lie one after the other."""
        self.known: dict[str | int, int] = {i: k for k, i in enumerate(self.special.values())}
        self.ids = np.fromiter(self.special.values(), np.int32, len(self.special))
        self.sizes = np.ones(len(self.special), dtype=np.int64)
        self.starts = np.arange(len(self.special), dtype=np.int64)

    def apart(self, a: np.ndarray, b: np.ndarray, skip_first: bool = False) -> np.ndarray:
        """For each pair of neighbours: True if no merge crosses the boundary between them.

        Goes back in time: of the two pieces at the boundary, the one made last is undone, and the
        pair that then meets there must not have merged before the piece was made. Among equal
        ranks the left pair merges first.
        """
        fine = np.ones(len(a), dtype=bool)
        at = np.arange(len(a))
        x, y = a.copy(), b.copy()
        far = np.iinfo(np.int64).max
        until_x, until_y = np.full(len(a), far), np.full(len(a), far)
        first = skip_first
        while len(at):
            if not first:
                key = x * self.size + y
                spot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                rank = np.where(self.keys[spot] == key, self.values[spot], far)
                crossed = (rank < until_x) & (rank <= until_y) & (rank < far)
                fine[at[crossed]] = False
            else:
                crossed = np.zeros(len(at), dtype=bool)
            first = False
            go = ~crossed & (np.maximum(self.rank[x], self.rank[y]) >= 0)
            at, x, y, until_x, until_y = (v[go] for v in (at, x, y, until_x, until_y))
            undo_x = self.rank[x] > self.rank[y]
            until_x = np.where(undo_x, self.rank[x], until_x)
            until_y = np.where(undo_x, until_y, self.rank[y])
            x, y = np.where(undo_x, self.right[x], x), np.where(undo_x, y, self.left[y])
        return fine

    def propose(self, word: str) -> list[int]:
        """Longest entries from the left; empty if there is a gap."""
        out, i, n, tree = [], 0, len(word), self.tree
        last = None if self.suffix else ""
        while i < n:
            at, found, j = tree, None, i
            for letter in word[i:] if i else word:
                at = at.get(letter)
                if at is None:
                    break
                j += 1
                made = at.get("" if j < n else last)
                if made is not None:
                    found, end = made, j
            if found is None:
                return []
            out.append(found)
            i = end
        return out

    def merge(self, word: str) -> list[int]:
        """Exact merging: the lowest rank first, and the leftmost of it.

        Pairs wait in a heap by rank and place, pieces are linked to their neighbours; a pair whose pieces
        have changed since is passed over. So a long word takes little more than linear time.
        """
        ids = [self.vocab[c] for c in word[:-1]] + [self.vocab[word[-1] + self.suffix]]
        n, ranks = len(ids), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = []
        for i, pair in enumerate(zip(ids, ids[1:])):
            if pair in ranks:
                rank, made = ranks[pair]
                queue.append((rank, i, *pair, made))
        heapify(queue)
        while queue:
            _, i, a, b, made = heappop(queue)
            j = after[i]
            if ids[i] != a or j == n or ids[j] != b:
                continue
            ids[i], ids[j] = made, GONE
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (ids[x], ids[y]) in ranks:
                    rank, joined = ranks[ids[x], ids[y]]
                    heappush(queue, (rank, x, ids[x], ids[y], joined))
        return [t for t in ids if t != GONE]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of distinct words, each given as byte letters."""
        guesses = [self.propose(w) for w in words]
        counts = np.array([len(g) for g in guesses], dtype=np.int64)
        flat = np.fromiter(itertools.chain.from_iterable(guesses), np.int64, int(counts.sum()))
        owner = np.repeat(np.arange(len(words)), counts)
        good = counts > 0
        good[owner[~self.sound[flat]]] = False
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, back = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
        fine = self.apart(pairs // self.size, pairs % self.size)[back]
        good[owner[inner[~fine]]] = False
        return [g if ok else self.merge(w) for w, g, ok in zip(words, guesses, good)]

    def plain_words(self, text: str) -> list[str]:
        """The words of a text without special tokens, normalised."""
        if text.isascii():
            return self.ascii_words.findall(text.lower())
        return self.words.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def split(self, text: str | None) -> list[str | int]:
        """Words, and ids of special tokens; these are sought in the text as it is."""
        if not text:
            return []
        if not self.special or not self.split_special.search(text):
            return self.plain_words(text)
        out: list[str | int] = []
        for part in self.split_special.split(text):
            out += [self.special[part]] if part in self.special else self.plain_words(part)
        return out

    def learn(self, words: list[str]) -> None:
        """Encode distinct words that aren't known yet, all at once."""
        spelled = [w if w.isascii() else w.encode("utf-8", "replace").decode("latin-1") for w in words]
        spelled = [w if w.isascii() and w.isprintable() else w.translate(self.letters) for w in spelled]
        coded = self.encode_words(spelled)
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        ids = np.fromiter(itertools.chain.from_iterable(coded), np.int32, int(sizes.sum()))
        self.known.update(zip(words, itertools.count(len(self.sizes))))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        """The ids of every text."""
        cut = [self.split(t) for t in texts]
        flat = list(itertools.chain.from_iterable(cut))
        code = list(map(self.known.get, flat))
        new = list(dict.fromkeys(w for w, k in zip(flat, code) if k is None)) if None in code else []
        if new and len(self.known) + len(new) > CACHED_WORDS:
            self.forget()
            new = [w for w in dict.fromkeys(flat) if w not in self.known]
        if new:
            self.learn(new)
            code = list(map(self.known.__getitem__, flat))
        code = np.array(code, dtype=np.int64)
        ids, sizes, starts = self.ids, self.sizes, self.starts
        size = sizes[code]
        total = np.concatenate([[0], np.cumsum(size)])
        take = np.repeat(starts[code] - total[:-1], size) + np.arange(total[-1])
        ends = total[np.cumsum([0, *map(len, cut)])]
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids[take]))

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The text of every list of ids."""
        flat = ids.flatten()
        inside = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, self.size))
        entries = self.entries.take(pc.if_else(inside, flat, None))
        entries = pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0))])
                     .astype(np.int32)), entries)
        if flat.null_count or entries.values.null_count:
            return pa.array([" ".join(w for w in e if w is not None) for e in entries.to_pylist()],
                            pa.string())
        return pc.binary_join(entries, " ")


def _tables(spec: Broadcast) -> Bpe:
    """Built once in each worker process and kept with the broadcast value."""
    value = spec.value
    if "tables" not in value:
        value["tables"] = Bpe(value)
    return value["tables"]


def _apply(docs: DataFrame, path: str, made: dict[str, T.DataType], work, keep: list[str] | None = None) -> DataFrame:
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(load_vocabulary(path))
    docs = docs.drop(*made)
    names = docs.columns if keep is None else keep
    schema = T.StructType([*[docs.schema[n] for n in names], *[T.StructField(k, v) for k, v in made.items()]])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _tables(spec)
        for part in batch_slices(batches, "text", SLICE) if "ids" in made else batches:
            new = work(tables, part)
            columns = [part.column(n).cast(arrow.field(n).type) for n in names]
            yield pa.RecordBatch.from_arrays(
                columns + [new[k].cast(arrow.field(k).type) for k in made], schema=arrow)

    return text_batches(docs).mapInArrow(run, schema)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """Adds ``ids`` (array of int) of the column ``text``."""
    return _apply(docs, path, {"ids": T.ArrayType(T.IntegerType())},
                  lambda t, part: {"ids": t.encode(part.column("text").to_pylist())})


def decode(rows: DataFrame, path: str) -> DataFrame:
    """Adds ``decoded``, the text of the column ``ids``."""
    return _apply(rows, path, {"decoded": T.StringType()},
                  lambda t, part: {"decoded": t.decode(part.column("ids"))})


def round_trip(docs: DataFrame, path: str, keep: list[str] | None = None) -> DataFrame:
    """Adds ``ids`` and ``decoded`` in one pass over ``text``; ``keep`` names the columns that go on."""
    def both(t: Bpe, part: pa.RecordBatch) -> dict[str, pa.Array]:
        ids = t.encode(part.column("text").to_pylist())
        return {"ids": ids, "decoded": t.decode(ids)}

    made = {"ids": T.ArrayType(T.IntegerType()), "decoded": T.StringType()}
    return _apply(docs, path, made, both, keep)


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def digests(coded: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of encoded and decoded rows."""
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(listed, 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(round_trip(docs, default_path(), keep=["doc_id"]))
