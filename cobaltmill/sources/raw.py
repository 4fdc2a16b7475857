"""Raw delimited text: line scan, encoding choice, separator choice, all-string cells."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cobaltmill.operators.ordering import locf, running_before
from cobaltmill.session import computed_once, materialise

SEPARATORS = (",", ";", "|", "\t")
FALLBACK_ENCODING = "iso-8859-1"
#: A quoted cell that would span more lines than this is taken for the work of a stray quote.
RECORD_LINES = 10_000


def line_scan(spark: SparkSession, path: str) -> DataFrame:
    """Lines as (file, split_start, row_id, line) in one pass without a shuffle.

    ``row_id`` is the byte offset of the split plus the line's position in its partition. A line
    takes at least one byte, so ids are unique and ascending within a file, and consecutive within
    a split. Undecodable bytes are kept as they are.
    """
    start = F.col("_metadata.file_block_start")
    position = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), start.alias("split_start"),
        (start + position).alias("row_id"), F.col("value").alias("line"),
    )


def _mark_count(line: Column, mark: str) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(mark), F.lit("")))


def file_facts(lines: DataFrame) -> DataFrame:
    """Per file: encoding, separator and the largest number of separators on a line.

    utf-8 when every line is valid, else the single-byte fallback. The separator is the one with
    the steadiest count per line among those that occur at least once a line on average; a comma
    when none does. Separators inside quotes that close on their line don't count. One aggregate that
    combines map-side.
    """
    bare = F.when(F.contains("line", F.lit('"')), F.regexp_replace("line", '"[^"]*"', "")).otherwise(F.col("line"))
    lines = lines.withColumn("bare", bare)
    aggs = [F.count_if(F.length("line") > 0).alias("n"), F.bool_and(F.is_valid_utf8("line")).alias("valid")]
    for i, mark in enumerate(SEPARATORS):
        count = _mark_count(F.col("bare"), mark).cast("long")
        aggs += [
            F.sum(count).alias(f"s{i}"), F.sum(count * count).alias(f"q{i}"), F.max(count).alias(f"m{i}"),
        ]

    def wide(name: str) -> Column:
        return F.col(name).cast("decimal(19,0)")  # products of sums over long files pass a bigint

    choices = F.array(*[
        F.struct(
            (wide("n") * wide(f"q{i}") - wide(f"s{i}") * wide(f"s{i}")).alias("spread"),
            F.lit(i).alias("pos"), F.lit(mark).alias("sep"), F.col(f"m{i}").alias("marks"),
            (F.col(f"s{i}") >= F.col("n")).alias("usable"),
        )
        for i, mark in enumerate(SEPARATORS)
    ])
    best = F.array_min(F.filter(choices, lambda c: c["usable"]))
    encoding = F.when(F.col("valid"), "utf-8").otherwise(FALLBACK_ENCODING)
    sums = lines.groupBy("file").agg(*aggs)
    return sums.select("file", encoding.alias("encoding"), F.coalesce(best, choices[0]).alias("b")).select(
        "file", "encoding", "b.sep", "b.marks"
    )


def decoded(body: Column, encoding: str) -> Column:
    """Bytes as text; single-byte encodings that Spark doesn't know differ from Latin-1 by a few letters."""
    try:
        upper = {chr(b): bytes([b]).decode(encoding, "ignore") for b in range(128, 256)}
    except LookupError:
        raise ValueError(f"unknown encoding {encoding!r}") from None
    if all(len(letter) < 2 for letter in upper.values()) and len("é".encode(encoding, "ignore")) < 2:
        other = {b: letter or "\ufffd" for b, letter in upper.items() if b != letter}
        text = F.decode(body, FALLBACK_ENCODING)
        return F.translate(text, "".join(other), "".join(other.values())) if other else text
    return F.decode(body, encoding)


def split_cells(line: Column, sep: Column) -> Column:
    """Quote-aware split of one line into its cells, however many; an empty cell is null.

    A quoted cell may hold the separator and doubled quotes.
    """
    def parsed(mark: str) -> Column:
        cell = f"(?<=^|{re.escape(mark)})(\"(?:[^\"]|\"\")*\"|[^{re.escape(mark)}]*)"
        return F.regexp_extract_all(line, F.lit(cell), 1)

    out = F.when(sep == SEPARATORS[0], parsed(SEPARATORS[0]))
    for mark in SEPARATORS[1:]:
        out = out.when(sep == mark, parsed(mark))

    def plain(cell: Column) -> Column:
        inner = F.replace(F.substring(cell, F.lit(2), F.length(cell) - 2), F.lit('""'), F.lit('"'))
        quoted = (F.length(cell) > 1) & cell.startswith('"') & cell.endswith('"')
        return F.when(quoted, inner).otherwise(F.nullif(cell, F.lit("")))

    return F.transform(out, plain)


def join_records(lines: DataFrame, longest: int = RECORD_LINES) -> DataFrame:
    """Join the lines of records whose quoted cells hold line feeds; a record keeps its first line's id.

    A line begins a record when an even number of quotes stands before it in its file. The counts run
    over blocks of lines, so a large file is not read by one task; a record is one group.

    A stray quote would make all lines to the next one a single record. What spans more than ``longest`` lines is
    taken for that: each of its lines is a record of its own, marked ``stray_quote``. So no line is lost
    and no group holds more than ``longest`` lines.
    """
    marks = lines.withColumn("__quotes", _mark_count(F.col("line"), '"').cast("long"))
    counted = running_before(marks, "row_id", ["file"], "__quotes", "__before")
    begun = counted.withColumn("__record", F.when(F.col("__before") % 2 == 0, F.col("row_id")))
    owned = materialise(locf(begun, "row_id", ["__record"], ["file"]), "record-lines")
    runs = owned.groupBy("file", "__record").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > longest)
    runs = materialise(runs.select("file", "__record", F.lit(True).alias("__stray")), "stray-records")
    stray = F.coalesce("__stray", F.lit(False))
    told = owned.join(runs, ["file", "__record"], "left").withColumns({
        "__record": F.when(stray, F.col("row_id")).otherwise(F.col("__record")), "stray_quote": stray})
    parts = F.array_sort(F.collect_list(F.struct("row_id", "line")))
    return told.groupBy("file", F.col("__record").alias("row_id"), "stray_quote").agg(
        F.min("split_start").alias("split_start"),
        F.array_join(F.transform(parts, lambda p: p["line"]), "\n").alias("line"))


def raw_scan(spark: SparkSession, path: str, sep: str | None = None, encoding: str | None = None,
             multiline: bool = False, longest: int = RECORD_LINES) -> DataFrame:
    """Headerless all-string read as (file, split_start, row_id, cells, encoding).

    A first pass finds each file's encoding and separator unless the caller names them, the second one
    splits the lines; a row has as many cells as its line. With ``multiline`` quoted cells may hold line
    feeds, up to ``longest`` lines (see :func:`join_records`, whose ``stray_quote`` comes along); without it a
    record is a line, and files are read without a shuffle.
    """
    lines = line_scan(spark, path)
    if sep is not None and encoding is not None:
        marked = lines.withColumns({"sep": F.lit(sep), "encoding": F.lit(encoding)})
    else:
        facts = file_facts(lines).select(
            "file", F.lit(encoding).alias("encoding") if encoding else "encoding",
            F.lit(sep).alias("sep") if sep else "sep")
        marked = lines.join(materialise(facts, "file-facts"), "file")  # stored, so the planner knows its size
    if multiline:
        told = marked.groupBy("file").agg(F.first("sep").alias("sep"), F.first("encoding").alias("encoding"))
        marked = join_records(lines, longest).join(materialise(told, "file-facts"), "file")
    text = F.when(F.lower("encoding") == "utf-8", F.col("line")).otherwise(
        decoded(F.col("line").cast("binary"), encoding or FALLBACK_ENCODING))
    return computed_once(marked, split_cells(text, F.col("sep")), "cells").select(
        "file", "split_start", "row_id", "cells", "encoding", *(["stray_quote"] if multiline else []))


def bounded_read(df: DataFrame, key: str, n: int | None = None, bins: int = 1024) -> DataFrame:
    """The ``n`` rows with the smallest ``key``, a unique whole number such as a row id; all by default.

    A plain ordered limit would send ``n`` rows of every partition to one task. Here counts per
    key range narrow the range first, until it holds at most twice ``n`` rows.
    """
    if n is None:
        return df
    keys = df.select(F.col(key).cast("long").alias("k"))
    low, high, rows = keys.agg(F.min("k"), F.max("k"), F.count("k")).first()
    below = 0  # rows known to lie under ``low``
    while rows and below + rows > 2 * n and high > low:
        width = (high - low) // bins + 1
        found = keys.filter(F.col("k").between(low, high)).groupBy(
            F.floor((F.col("k") - low) / width).alias("bin")).count()
        for r in sorted(found.collect()):  # at most ``bins`` rows
            if below + r["count"] >= n:
                break
            below += r["count"]
        low = low + r["bin"] * width
        high, rows = min(high, low + width - 1), r["count"]
    return (df if high is None else df.filter(F.col(key) <= high)).orderBy(key).limit(n)


def schema_sample(df: DataFrame, order: list[Column], rows: int = 2) -> DataFrame:
    """One row per column: its type and the text of the leading sample rows."""
    from pyspark.sql import Window as W

    sample = df.orderBy(*order).limit(rows)
    numbered = sample.withColumn("__n", F.row_number().over(W.orderBy(*order)))  # ``rows`` rows only
    cells = F.explode(F.array(*[
        F.struct(
            F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"),
            F.col(f.name).cast("string").alias("value"),
        )
        for f in df.schema.fields
    ]))
    flat = numbered.select("__n", cells.alias("c")).select("__n", "c.*")
    return flat.groupBy("column", "type").agg(
        *[F.max(F.when(F.col("__n") == i + 1, F.col("value"))).alias(f"sample_{i + 1}")
          for i in range(rows)]
    )
