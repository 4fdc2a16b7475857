"""The whole cleaning job for raw files: header, cells, types, catalogs, gaps."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cobaltmill.functions import numbers as N
from cobaltmill.functions import vocab
from cobaltmill.operators import cleaning as C
from cobaltmill.operators import fuzzy, headers
from cobaltmill.operators.ordering import locf
from cobaltmill.operators.profile import SHAPE_METRICS, name_hint, shape_aggregates
from cobaltmill.session import materialise

KEYS = ["file", "row_id"]


@dataclass
class CleanTable:
    """A cleaned table (lazy) of all files with one header, with what the profile passes found out.

    ``header_row`` and ``metadata_text`` are those of the first file; ``files`` has them for each.
    """

    table: DataFrame
    header_row: int
    columns: list[str]
    metadata_text: str
    files: DataFrame | None = None
    typed: DataFrame | None = None
    finish: Callable[[DataFrame], DataFrame] | None = None

    def preview(self, rows: int = 5) -> DataFrame:
        """Leading rows in file order with header row and metadata; a sample by design.

        Gaps are filled from earlier rows, so the leading typed rows are enough.
        """
        found = headers.document_metadata(F.lit(self.metadata_text))
        lead = self.table if self.typed is None else self.finish(self.typed.orderBy(*KEYS).limit(rows))
        return (
            lead.orderBy(*KEYS).limit(rows)
            .withColumn("header_row", F.lit(self.header_row).cast("long"))
            .withColumn("was_cleaned", F.lit(True))
            .withColumn("document_metadata", found)
        )


def route_catalog(name: str) -> str | None:
    """Catalog for a column name; the same rules as ``functions.text.catalog_name``."""
    lowered = name.lower()
    for words, catalog in vocab.CATALOG_RULES:
        if any(w in lowered for w in words):
            return catalog
    return None


def clean_table(raw: DataFrame, matching: str = "substring", scorer: str = "ratio") -> CleanTable:
    """Clean raw files (file, row_id, cells) that share one header; others go to :func:`clean_files`."""
    done = clean_files(raw, matching, scorer)
    if len(done) > 1:
        raise ValueError("the files have different headers: " + "; ".join(
            ", ".join(d.columns) for d in done) + "; use clean_files")
    return done[0] if done else CleanTable(raw.select(*KEYS).limit(0), 0, [], "")


def clean_files(raw: DataFrame, matching: str = "substring", scorer: str = "ratio",
                lead: int | None = None) -> list[CleanTable]:
    """Clean raw files given as (file, row_id, cells), each below its own header.

    Files with the same column names make one table; types are found per table, gaps are filled per
    file. The leading rows are read once for all headers; each table is profiled in one pass, typed in
    one projection, and stored once before its gaps are filled. Only one row per header and one profile
    row per table reach the driver.

    With ``lead`` only that many leading rows of each table are typed, stored and returned, for a preview; types
    come from the profile of all rows as ever.
    """
    facts = materialise(headers.file_headers(raw), "file-headers")
    first = F.min(F.struct("file", "header_row", "metadata_text")).alias("first")
    layouts = facts.groupBy("names").agg(first).collect()  # one row per header
    return [_clean_layout(raw, facts, r["names"], r["first"], matching, scorer, lead)
            for r in sorted(layouts, key=lambda r: r["first"]["file"])]


def _clean_layout(raw: DataFrame, facts: DataFrame, names: list[str], first, matching: str,
                  scorer: str, lead: int | None) -> CleanTable:
    own = facts.filter(F.col("names") == F.lit(names))
    files = own.select("file", "header_row", "metadata_text")
    body = raw.join(own.select("file", "header_id"), "file").filter(F.col("row_id") > F.col("header_id"))
    body = body.select(*KEYS, *[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)])
    nothing = CleanTable(body.select(*KEYS).limit(0), first["header_row"], [], first["metadata_text"], files)
    if not names:
        return nothing
    body = C.normalise_cells(body, names)
    aggs = [*shape_aggregates(names), *_rates(names, matching)]
    profile = body.agg(*aggs).first()
    blank, split = C.shape_plan([
        {"column": c} | {m: profile[f"{m}_{i}"] for m in SHAPE_METRICS} for i, c in enumerate(names)])
    shares = {c: [profile[f"r{3 * i + k}"] for k in range(3)] for i, c in enumerate(names)}
    body = C.reshape(body, blank, split)
    cols = [c for c in body.columns if c not in KEYS]
    if not cols:
        return nothing
    parts = [c for c in cols if c not in shares]
    if parts:  # columns made by a split are profiled on their own
        found = body.agg(*_rates(parts, matching)).first()
        shares |= {c: [found[3 * i + k] for k in range(3)] for i, c in enumerate(parts)}

    if lead is not None:
        body = body.orderBy(*KEYS).limit(lead)
    typed, additive, forward = _typed(body, cols, shares, matching)
    typed = materialise(C.impute_additive(typed, additive) if additive else typed, "typed")

    def finish(rows: DataFrame) -> DataFrame:
        filled = locf(rows, "row_id", [c for c in cols if c not in additive], ["file"])
        numbers = {c: F.coalesce(F.col(f"`{c}`"), F.lit(0.0)) for c in forward}
        filled = filled.withColumns(numbers) if numbers else filled
        texts = [f.name for f in typed.schema.fields if f.dataType.simpleString() == "string" and f.name in cols]
        for c in texts:  # a known value keeps its term wherever it fills a gap
            catalog = route_catalog(c)
            filled = fuzzy.harmonize(filled, c, catalog, scorer, values=rows) if catalog else filled
        done = filled.withColumns({c: F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in texts})
        return done.select(*KEYS, *[F.col(f"`{c}`") for c in cols])

    return CleanTable(finish(typed), first["header_row"], cols, first["metadata_text"], files, typed, finish)


def _rates(cols: list[str], matching: str) -> list:
    """Three rates per column: id-like share, number rate, date rate; only those its name calls for."""
    nothing, rates = F.lit(0.0), []
    for c in cols:
        value = F.col(f"`{c}`")
        dated, critical = (name_hint(c, h, matching) for h in (vocab.DATE_HINTS, vocab.CRITICAL_HINTS))
        rates += [
            F.avg(F.when(value.isNotNull(), N.id_like(value).cast("double")))
            if not name_hint(c, vocab.ID_HINTS, matching) else F.max(nothing),
            C.parse_rate(C.typed_value(value, c, False, matching)) if critical else F.max(nothing),
            F.avg(F.when(N.parse_date(value).isNotNull(), 1.0).otherwise(0.0))
            if dated else F.max(nothing),
        ]
    return [r.alias(f"r{i}") for i, r in enumerate(rates)]


def _typed(body: DataFrame, cols: list[str], shares: dict[str, list[float | None]], matching: str):
    """Types from names and rates; returns the table and the imputation plan."""
    def hinted(name: str, hints: tuple[str, ...]) -> bool:
        return name_hint(name, hints, matching)

    out, additive, forward = [F.col(k) for k in KEYS], [], []
    for c in cols:
        id_share, rate, date_rate = (v or 0.0 for v in shares[c])
        is_id = hinted(c, vocab.ID_HINTS) or id_share >= vocab.ID_DENSITY
        value = C.typed_value(F.col(f"`{c}`"), c, is_id, matching)
        if hinted(c, vocab.DATE_HINTS) and date_rate >= vocab.NUMERIC_PARSE_RATE:
            value = N.parse_date(F.col(f"`{c}`"))
        elif hinted(c, vocab.CRITICAL_HINTS) and not is_id and rate >= vocab.NUMERIC_PARSE_RATE:
            value = N.to_number(value)
            (additive if hinted(c, vocab.ADDITIVE_HINTS) else forward).append(c)
        out.append(value.alias(c))
    return body.select(*out), additive, forward
