"""Cut texts into overlapping chunks or message blocks, with column expressions only.

A text is held as segments of one window's length, so that any window is found in two of them. A fold over
the text carries only a position and the spans of the pieces; it ends with an error, never with a lost end,
should it not reach the end of a text. Documents run in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cobaltmill.functions import text as T
from cobaltmill.functions import vocab

_SPANS = "array<struct<at:int,took:int,is_tail:boolean>>"


def _after_last(window: Column, mark: str) -> Column:
    """Characters of the window up to and with its last ``mark``; 0 if it does not occur."""
    return F.length(window) - F.length(F.substring_index(window, mark, -1))


def _folded(df: DataFrame, key: str, text: str, size: int, steps: Column, cut) -> DataFrame:
    """``key, chunk_index, chunk, is_tail``: the pieces that ``cut`` finds from position to position.

    ``cut(window, left)`` gets the text from the position on, at least ``size + 1`` characters of it if there
    are as many, and how many are left. It returns the characters taken as a piece (0 for none) and passed.
    """
    parts = df.select(key, T.strip(F.coalesce(F.col(text), F.lit(""))).alias("__text"))
    parts = parts.select(key, F.length("__text").alias("__n"), F.regexp_extract_all(
        "__text", F.lit(f"(?s).{{1,{size}}}"), F.lit(0)).alias("__parts"))

    def window(at: Column, length: Column | int) -> Column:
        first = F.floor(at / size).cast("int")
        two = F.concat(F.get("__parts", first), F.coalesce(F.get("__parts", first + 1), F.lit("")))
        return F.substring(two, at % size + 1, length)

    def step(state: Column, _: Column) -> Column:
        at, left = state["at"], F.col("__n") - state["at"]

        def advance(found: Column) -> Column:
            span = F.struct(at.alias("at"), found["took"].alias("took"),
                            (state["covered"] >= F.col("__n")).alias("is_tail"))
            return F.struct(
                (at + found["passed"]).alias("at"),
                F.greatest(state["covered"], at + found["took"]).alias("covered"),
                F.when(found["took"] > 0, F.array_append(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

        here = T.let(window(at, size + 1), lambda w: cut(w, left))
        return F.when(left <= 0, state).otherwise(T.let(here, advance))

    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("covered"), F.array().cast(_SPANS).alias("spans"))
    turns = F.sequence(F.lit(1), F.greatest(steps.cast("int"), F.lit(1)))
    folded = parts.withColumn("__end", F.explode(F.array(F.aggregate(turns, start, step))))
    whole = F.when(F.col("__end.at") >= F.col("__n"), F.col("__end.spans")).otherwise(
        F.raise_error(F.lit("a text was not cut to its end")).cast(_SPANS))
    pieces = F.transform(whole, lambda s: F.struct(window(s["at"], s["took"]).alias("chunk"), s["is_tail"].alias("is_tail")))
    return folded.select(key, pieces.alias("__pieces"))


def _numbered(pieces: DataFrame, key: str, kept: Column) -> DataFrame:
    return pieces.select(key, F.posexplode(kept).alias("chunk_index", "__piece")).select(
        key, F.col("chunk_index").cast("long").alias("chunk_index"), "__piece.chunk", "__piece.is_tail")


def chunk_text(df: DataFrame, key: str, text: str, size: int = vocab.CHUNK_CHARS,
               overlap: int = vocab.CHUNK_OVERLAP) -> DataFrame:
    """Windows of ``size`` characters cut after the last line feed, else after the last sentence end.

    The next window goes back by ``overlap`` characters, unless the piece is no longer than that.
    ``is_tail`` marks a last piece that only repeats the overlap. Blank pieces are left out.
    """
    def cut(window: Column, left: Column) -> Column:
        def at_break(took: Column) -> Column:
            passed = F.when(took > overlap, took - overlap).otherwise(took)
            return F.struct(took.alias("took"), passed.alias("passed"))

        feed, stop = _after_last(window, "\n"), _after_last(window, ". ")
        last = F.when(feed > 0, feed).when(stop > 0, stop - 1).otherwise(size)
        return T.let(F.when(left > size, last).otherwise(size), at_break)

    # A break ends at most two windows, and past it none is left in the window before: eight steps in a row
    # (four for each kind of break) pass a window without its two overlaps.
    sure = size - 2 * overlap
    steps = F.ceil(F.col("__n") / sure) * 8 + 8 if sure > 0 else F.col("__n")
    pieces = _folded(df, key, text, size, steps, cut)
    stripped = F.transform("__pieces", lambda p: F.struct(T.strip(p["chunk"]).alias("chunk"), p["is_tail"].alias("is_tail")))
    return _numbered(pieces, key, F.filter(stripped, lambda p: p["chunk"] != ""))


def split_message(df: DataFrame, key: str, text: str, size: int = vocab.MESSAGE_LIMIT) -> DataFrame:
    """Message blocks of at most ``size`` characters, cut after the last line feed past the middle.

    White space at the front of a block is passed over.
    """
    def cut(window: Column, left: Column) -> Column:
        def take(blank: Column) -> Column:
            feed = _after_last(F.substring(window, 1, size), "\n")
            took = F.when(left <= size, left).when(feed > size // 2 + 1, feed).otherwise(size)
            took = F.when(blank > 0, 0).otherwise(took)
            return F.struct(took.alias("took"), F.greatest(took, blank).alias("passed"))

        return T.let(F.length(window) - F.length(T.lstrip(window)), take)

    # Every block takes half a size at least, and each may be followed by one step over white space.
    steps = F.ceil(F.col("__n") / max(size // 2, 1)) * 2 + F.ceil(F.col("__n") / size) + 2
    return _numbered(_folded(df, key, text, size, steps, cut), key, F.col("__pieces")).drop("is_tail")


def chunk_fixed(df: DataFrame, key: str, text: str, size: int = vocab.CHUNK_CHARS,
                overlap: int = vocab.CHUNK_OVERLAP) -> DataFrame:
    """Fixed windows without a boundary search."""
    length = F.length(text)
    starts = F.sequence(F.lit(1), length, F.lit(size - overlap))
    return (
        df.filter(length > 0).select(key, text, F.posexplode(starts).alias("chunk_index", "start"))
        .select(key, F.col("chunk_index").cast("long").alias("chunk_index"),
                F.substring(F.col(text), F.col("start"), F.lit(size)).alias("chunk"))
    )


def batch_assign(chunks: DataFrame, batch: int = vocab.EMBED_BATCH) -> DataFrame:
    """The embedding batch of each chunk within its document."""
    return chunks.withColumn("batch", F.floor(F.col("chunk_index") / batch))
