"""Hashed word shingles of whole texts, computed for many texts at a time with numpy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: An odd multiplier of the rolling word hash, and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
PLACES = tuple(np.uint64(x) for x in (
    0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))


def batch_slices(batches: Iterable[pa.RecordBatch], column: str, size: int) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows with about ``size`` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        run = (np.cumsum(lengths, dtype=np.int64) - lengths) // size
        cuts = np.flatnonzero(np.diff(run)) + 1
        for start, stop in zip([0, *cuts], [*cuts, batch.num_rows]):
            yield batch.slice(int(start), int(stop - start))


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), dtype=np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, A-Z lower-cased, and the text that each belongs to."""
    parts = [(t or "").encode("utf-8", "replace") for t in texts]
    raw = np.frombuffer(b" ".join([*parts, b""]), dtype=np.uint8)
    raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw)
    inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edge = np.diff(inside.astype(np.int8), prepend=0)
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(raw)), dtype=np.uint64)
    before = np.where(starts > 0, sums[starts - 1], np.uint64(0))
    hashes = scramble((sums[stops - 1] - before) * powers(BASE_INVERSE, len(raw))[starts])
    ends = np.cumsum([len(p) + 1 for p in parts])
    return hashes, np.searchsorted(ends, starts, side="right")


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text.

    A shingle is ``width`` words in a row; a shorter text is one shingle, a text without words none.
    """
    hashes, owner = word_hashes(texts)
    counts = np.bincount(owner, minlength=len(texts))
    firsts = np.concatenate([[0], np.cumsum(counts)])
    rolled = np.zeros(max(len(hashes) - width + 1, 0), dtype=np.uint64)
    for k in range(width):
        rolled += hashes[k:len(hashes) - width + 1 + k] * PLACES[k % 4] if len(rolled) else rolled
        rolled = scramble(rolled) if k % 4 == 3 and k + 1 < width else rolled
    rolled = scramble(rolled)
    out = []
    for at, n in zip(firsts, counts):
        if n >= width:
            out.append(np.unique(rolled[at:at + n - width + 1]))
        elif n:
            short = np.array([n], dtype=np.uint64)
            for k in range(at, at + n):
                short = scramble(short * PLACES[0] + hashes[k:k + 1])
            out.append(short)
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
