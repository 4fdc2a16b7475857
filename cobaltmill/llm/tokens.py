"""Hashes of the tokens of many texts at a time, for tokens given by the bytes they may hold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from cobaltmill.llm.shingles import BASE, BASE_INVERSE, powers, scramble

#: Bytes worked on at a time; a longer token still is in one piece.
RUN = 1 << 20


def byte_class(separators: str) -> np.ndarray:
    """For each byte, whether it is part of a token; all bytes above 127 are."""
    inside = np.ones(256, dtype=bool)
    inside[[ord(c) for c in separators]] = False
    return inside


#: Words: all but the space and the controls 9 to 13.
WORDS = byte_class(" \t\n\v\f\r")
#: Terms: ASCII letters and digits, and all that is not ASCII.
TERMS = byte_class("".join(chr(c) for c in range(128) if not chr(c).isalnum()))

_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if base not in _POWERS or len(_POWERS[base]) < n:
        _POWERS[base] = powers(base, max(n, RUN))
    return _POWERS[base][:n]


def _run_hashes(raw: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the tokens of a run of bytes."""
    raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw)
    edge = np.diff(inside[raw].astype(np.int8), prepend=0, append=0)
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = (raw.astype(np.uint64) + np.uint64(1)) * _powers(BASE, len(raw))
    sums = np.cumsum(sums, out=sums)
    before = np.where(starts > 0, sums[starts - 1], np.uint64(0))
    return scramble((sums[stops - 1] - before) * _powers(BASE_INVERSE, len(raw))[starts]), starts


def _runs(raw: np.ndarray, inside: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cut bytes where no token is cut, into runs of about ``RUN`` bytes."""
    at = 0
    while at < len(raw):
        stop = min(at + RUN, len(raw))
        while stop < len(raw) and inside[raw[stop]]:
            more = np.flatnonzero(~inside[raw[stop:stop + RUN]])
            stop = stop + int(more[0]) if len(more) else min(stop + RUN, len(raw))
        yield at, stop
        at = stop


def token_hashes(texts: list[str | None], inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all tokens of all texts, A-Z lower-cased, and the number of tokens of each text.

    Null is like the empty text. Memory beyond the bytes and the hashes is bounded by ``RUN``, except for a
    longer single token.
    """
    parts = [(t or "").encode("utf-8", "replace") for t in texts]
    raw = np.frombuffer(b" ".join([*parts, b""]), dtype=np.uint8)
    ends = np.cumsum([len(p) + 1 for p in parts], dtype=np.int64)
    hashes, counts = [np.zeros(0, np.uint64)], np.zeros(len(parts), np.int64)
    for at, stop in _runs(raw, inside):
        found, starts = _run_hashes(raw[at:stop], inside)
        hashes.append(found)
        owner = np.searchsorted(ends, starts + at, side="right")
        counts += np.bincount(owner, minlength=len(parts))
    return np.concatenate(hashes), counts
