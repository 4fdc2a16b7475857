"""Header rows of raw tables held as (file, row_id, cells)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cobaltmill.functions import text as T
from cobaltmill.functions import vocab
from cobaltmill.operators.ordering import first_n, occurrence_number


def _blankish(c: Column) -> Column:
    return F.lower(c).isin("", "nan", "none")


def token_score(cells: Column) -> Column:
    """Number of header keywords among the tokens of a row."""
    words = F.array(*[F.lit(w) for w in vocab.HEADER_KEYWORDS])

    def hits(cell: Column) -> Column:
        lowered = F.lower(T.norm_text(F.coalesce(cell, F.lit(""))))
        tokens = F.split(lowered, T.HEADER_TOKEN_SPLIT)
        return F.size(F.filter(tokens, lambda t: F.array_contains(words, t)))

    return F.aggregate(cells, F.lit(0), lambda total, cell: total + hits(cell))


def substring_score(cells: Column) -> Column:
    """Older score: keywords that occur anywhere in a cell."""

    def found(lowered: Column) -> Column:
        total = sum(
            (F.when(lowered.contains(w), 1).otherwise(0)
             for w in vocab.TRANSACTION_HEADER_KEYWORDS),
            F.lit(0),
        )
        return F.when(_blankish(lowered), 0).otherwise(total)

    def hits(cell: Column) -> Column:
        return T.let(F.lower(T.strip(F.coalesce(cell, F.lit("")))), found)

    return F.aggregate(cells, F.lit(0), lambda total, cell: total + hits(cell))


def leading_rows(raw: DataFrame, depth: int) -> DataFrame:
    """The first ``depth`` rows of each file with their ``line_no`` from 0.

    A scan marks the first split of a file (``split_start`` 0); without that column ``row_id``
    itself counts from 0.
    """
    if "split_start" not in raw.columns:
        return raw.filter(F.col("row_id") < depth).withColumn("line_no", F.col("row_id"))
    first = raw.filter(F.col("split_start") == 0)
    top = first_n(first, ["file"], [F.col("row_id")], depth)
    return top.withColumn("line_no", (F.col("rank") - 1).cast("long")).drop("rank")


def header_rows(raw: DataFrame, mode: str = "token") -> DataFrame:
    """One row per file: the header row and its score.

    Only the leading rows are scored (24, or 12 for the older score). A later row is the header
    when it scores at least 2 and more than row 0; ties go to the earlier row.
    """
    score = token_score if mode == "token" else substring_score
    depth = vocab.HEADER_SCAN_ROWS if mode == "token" else vocab.TRANSACTION_SCAN_ROWS
    scored = leading_rows(raw, depth).select(
        "file", "line_no", score(F.col("cells")).alias("score")
    )
    best = F.max_by("line_no", F.struct("score", (-F.col("line_no")).alias("earlier")))
    per_file = scored.groupBy("file").agg(
        best.alias("best_row"),
        F.max("score").alias("best_score"),
        F.max(F.when(F.col("line_no") == 0, F.col("score"))).alias("first_score"),
    )
    taken = (F.col("best_row") > 0) & (F.col("best_score") >= 2) & (
        F.col("best_score") > F.col("first_score")
    )
    return per_file.select(
        "file",
        F.when(taken, F.col("best_row")).otherwise(0).cast("long").alias("header_row"),
        F.col("best_score").cast("long").alias("best_score"),
    )


def dedupe_headers(headers: DataFrame) -> DataFrame:
    """Header cells (file, idx, name) to unique column names: blanks get a number, repeats a suffix.

    The suffix is the next number, from 2, that makes a name the row doesn't hold already.
    """
    base = T.norm_text(F.coalesce("name", F.lit("")))
    numbered = F.concat(F.lit("col_"), (F.col("idx") + 1).cast("string"))
    named = headers.withColumn("base", F.when(_blankish(base), numbered).otherwise(base))
    ranked = occurrence_number(named, "idx", ["file", "base"], "__seen", levels=1)
    held = named.groupBy("file").agg(F.collect_set("base").alias("__held"))  # the cells of one row

    def suffixed(k: Column) -> Column:
        return F.concat_ws("_", "base", k.cast("string"))

    tries = F.transform(F.sequence(F.lit(2).cast("long"), F.col("__seen") + F.size("__held") + 1), suffixed)
    free = F.get(F.filter(tries, lambda t: ~F.array_contains("__held", t)), (F.col("__seen") - 2).cast("int"))
    return ranked.join(held, "file").select(
        "file", "idx", F.when(F.col("__seen") == 1, F.col("base")).otherwise(free).alias("column")
    )


def unique_names(cells: Column) -> Column:
    """The cells of one header row as unique column names, by the rules of :func:`dedupe_headers`."""
    def base(cell: Column, i: Column) -> Column:
        clean = T.norm_text(F.coalesce(cell, F.lit("")))
        return F.when(_blankish(clean), F.concat(F.lit("col_"), (i + 1).cast("string"))).otherwise(clean)

    def named(bases: Column) -> Column:
        def name(b: Column, i: Column) -> Column:
            seen = F.size(F.filter(F.slice(bases, F.lit(1), i + 1), lambda x: x == b))
            tries = F.transform(F.sequence(F.lit(2), seen + F.size(bases) + 1),
                                lambda k: F.concat_ws("_", b, k.cast("string")))
            free = F.filter(tries, lambda t: ~F.array_contains(bases, t))
            return F.when(seen == 1, b).otherwise(F.get(free, seen - 2))

        return F.transform(bases, name)

    return T.let(F.transform(cells, base), named)


def file_headers(raw: DataFrame, depth: int = vocab.HEADER_SCAN_ROWS) -> DataFrame:
    """One row per file: ``header_row``, its ``header_id``, column ``names`` and ``metadata_text``.

    Reads the leading rows of each file only; the widest of them decides how many columns there are (a
    header may be shorter than the rows below it). The rules are those of :func:`header_rows`,
    :func:`dedupe_headers` and :func:`preamble_text`.
    """
    scored = leading_rows(raw, depth).select(
        "file", F.struct("line_no", "row_id", token_score(F.col("cells")).alias("score"), "cells").alias("r"))
    grouped = scored.groupBy("file").agg(F.array_sort(F.collect_list("r")).alias("rows"))  # ``depth`` rows at most
    best = F.array_max(F.transform("rows", lambda r: F.struct(r["score"], (-r["line_no"]).alias("earlier"))))
    first = F.get(F.filter("rows", lambda r: r["line_no"] == 0), F.lit(0))["score"]
    chosen = grouped.withColumn("best", best).withColumn("header_row", F.when(
        (F.col("best.score") >= 2) & (F.col("best.score") > F.coalesce(first, F.lit(0))) & (F.col("best.earlier") < 0),
        -F.col("best.earlier")).otherwise(0).cast("long"))
    header = F.get(F.filter("rows", lambda r: r["line_no"] == F.col("header_row")), F.lit(0))
    width = F.array_max(F.transform("rows", lambda r: F.size(r["cells"])))
    cells = F.concat(header["cells"], F.array_repeat(F.lit(None).cast("string"), width - F.size(header["cells"])))
    above = F.filter("rows", lambda r: r["line_no"] < F.col("header_row"))
    lines = F.filter(F.transform(above, lambda r: _preamble_line(r["cells"])), lambda line: line != "")
    return chosen.select(
        "file", "header_row", F.coalesce(header["row_id"], F.lit(-1)).alias("header_id"),
        F.coalesce(unique_names(cells), F.array().cast("array<string>")).alias("names"),
        T.strip(F.array_join(F.slice(lines, 1, 20), "\n")).alias("metadata_text"))


def _preamble_line(cells: Column) -> Column:
    cleaned = F.transform(cells, lambda cell: T.norm_text(F.coalesce(cell, F.lit(""))))
    return F.array_join(F.filter(cleaned, lambda cell: cell != ""), " | ")


def preamble_text(raw: DataFrame, headers: DataFrame) -> DataFrame:
    """The rows above each file's header as text, blank cells and lines skipped, first 20 lines."""
    line = _preamble_line(F.col("cells"))
    above = (
        leading_rows(raw, vocab.HEADER_SCAN_ROWS)
        .join(headers.select("file", "header_row"), "file")
        .filter(F.col("line_no") < F.col("header_row"))
        .select("file", "row_id", line.alias("line"))
        .filter(F.col("line") != "")
    )
    lines = F.slice(F.sort_array(F.collect_list(F.struct("row_id", "line"))), 1, 20)
    return above.groupBy("file").agg(
        T.strip(F.array_join(F.transform(lines, lambda r: r["line"]), "\n")).alias("metadata_text")
    )


def document_metadata(text: Column) -> Column:
    """Source and declarant id found in a text."""
    declarant = F.regexp_extract(text, r"\b(\d{8,10}(?:-\w)?)\b", 1)
    source = F.when(F.lower(text).contains("dian"), "DIAN").otherwise("")
    blank = F.lit("")
    return F.struct(
        source.alias("fuente"), blank.alias("regimen"), blank.alias("periodo_inicio"),
        blank.alias("periodo_fin"), declarant.alias("nit_declarante"),
    )
