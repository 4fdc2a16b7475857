"""Remove boilerplate lines that many sites share, with DataFrame operations only.

A line's spread is its number of distinct sites. HyperLogLog sketches of the sites are built per
line hash and merge by aggregation, so a line that holds most rows is combined before the shuffle.
An estimate far from the threshold decides; lines whose estimate lies within ``band`` of it get
exact distinct counts. Lines found on ``min_sites`` or more sites are removed, except for the first
occurrence in the document with the smallest id, so that content copied between sites survives once.

Defined results:

- lines end at a line feed; spaces, tabs and carriage returns around them don't matter, blank lines
  always stay, and what stays is joined as it was;
- null text: stays null with 0 lines; empty text: one blank line; a text may lose all its lines and
  is then empty;
- null site: a site of its own; null id: after all other ids when the first occurrence is sought;
- equal rows (same id and text) get equal results; rows with one id and several texts are told
  apart by the text's hash;
- an empty table gives no rows; other columns pass through, and names of this operator's own columns
  (``n_lines``, ``n_removed``) are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cobaltmill.llm.common import free_names
from cobaltmill.session import materialise, table

MIN_SITES = 10
SKETCH_LG_K = 12
#: Fifteen standard errors of a sketch of 2^12 registers.
BAND = 0.25
MARGIN = " \t\r"


def wide_hash(*values: Column) -> list[Column]:
    """Two independent 64-bit hashes."""
    return [F.xxhash64(*values), F.xxhash64(F.lit(20011), *values)]


def site_lines(docs: DataFrame, site: Column) -> DataFrame:
    """``doc_id, t1, t2`` (hashes of the text), ``line_no, h1, h2`` (of the line), ``site``."""
    t1, t2 = wide_hash(F.col("text"))
    named = F.coalesce(F.concat(F.lit("s"), site.cast("string")), F.lit("n"))
    cut = docs.filter("text is not null").select(
        "doc_id", t1.alias("t1"), t2.alias("t2"), named.alias("site"),
        F.posexplode(F.split("text", "\n", -1)).alias("line_no", "_line"))
    cut = cut.withColumn("_line", F.btrim("_line", F.lit(MARGIN))).filter("_line != ''")
    h1, h2 = wide_hash(F.col("_line"))
    return cut.select("doc_id", "t1", "t2", "line_no", h1.alias("h1"), h2.alias("h2"), "site")


def wide_spread(lines: DataFrame, min_sites: int = MIN_SITES, band: float = BAND) -> DataFrame:
    """Lines on ``min_sites`` sites or more with their first occurrence: ``h1, h2, first``."""
    place = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("t1"), F.col("t2"),
                     F.col("line_no"))
    spread = lines.groupBy("h1", "h2").agg(
        F.hll_sketch_agg("site", SKETCH_LG_K).alias("sketch"), F.min(place).alias("first"))
    guess = spread.select("h1", "h2", "first", F.hll_sketch_estimate("sketch").alias("guess"))
    kept = materialise(guess.filter(F.col("guess") >= min_sites * (1 - band)), "line-spread")
    sure = kept.filter(F.col("guess") > min_sites * (1 + band))
    near = kept.filter(F.col("guess") <= min_sites * (1 + band))
    pairs = lines.join(near.select("h1", "h2"), ["h1", "h2"]).select("h1", "h2", "site").distinct()
    counted = pairs.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("sites")).filter(F.col("sites") >= min_sites)
    proven = near.join(counted.select("h1", "h2"), ["h1", "h2"])
    return sure.unionByName(proven).select("h1", "h2", "first")


def line_dedup(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES,
               band: float = BAND) -> DataFrame:
    """``docs`` with cleaned ``text`` and the counts ``n_lines`` and ``n_removed``."""
    docs = docs.drop("n_lines", "n_removed")
    lines = materialise(site_lines(docs, F.col(site)), "lines")
    wide = materialise(wide_spread(lines, min_sites, band), "line-wide")
    first = F.col("first")
    is_first = (first["doc_id"].eqNullSafe(F.col("doc_id")) & (first["t1"] == F.col("t1"))
                & (first["t2"] == F.col("t2")) & (first["line_no"] == F.col("line_no")))
    d, u1, u2, gone_at, cut_up = free_names(docs, "gone_id", "gone_t1", "gone_t2", "gone", "lines")
    removed = lines.join(wide, ["h1", "h2"]).filter(~is_first).groupBy(
        F.col("doc_id").alias(d), F.col("t1").alias(u1), F.col("t2").alias(u2)
    ).agg(F.collect_set("line_no").alias(gone_at))
    t1, t2 = wide_hash(F.col("text"))
    joined = docs.join(
        removed, (t1 == F.col(u1)) & (t2 == F.col(u2)) & F.col("doc_id").eqNullSafe(F.col(d)), "left")
    cut = joined.withColumn(cut_up, F.split("text", "\n", -1))
    count = F.coalesce(F.size(cut_up), F.lit(0))
    stay = F.array_except(F.sequence(F.lit(0), F.size(cut_up) - 1), F.col(gone_at))
    clean = F.array_join(F.transform(stay, lambda i: F.get(F.col(cut_up), i)), "\n")
    text = F.when(F.col(gone_at).isNull(), F.col("text")).otherwise(clean)
    gone = F.when(F.col(gone_at).isNull(), F.lit(0)).otherwise(F.size(gone_at))
    counts = [F.greatest(count, F.lit(0)).cast("long").alias("n_lines"),
              gone.cast("long").alias("n_removed")]
    return cut.select(
        *[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns], *counts)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return done.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars"),
                       F.sha2("text", 256).alias("text_sha256"))


#: Named steps over a relation ``docs`` (doc_id, text, source), so that the pipeline can reuse them.
LINE_STEPS = f"""
line_split AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS line_no
  FROM docs WHERE text IS NOT NULL),
line_keyed AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS k FROM line_split),
line_wide AS (
  SELECT k, min((doc_id, line_no)) AS first_place
  FROM line_keyed WHERE k <> '' GROUP BY k
  HAVING count(DISTINCT coalesce('s' || source, 'n')) >= {MIN_SITES}),
line_judged AS (
  SELECT l.doc_id, l.line_no, l.line,
         w.k IS NOT NULL AND (l.doc_id, l.line_no) <> w.first_place AS gone
  FROM line_keyed l LEFT JOIN line_wide w ON l.k = w.k),
line_done AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT gone), '') AS text
  FROM line_judged GROUP BY doc_id)
"""

SQL = f"""
WITH docs AS (SELECT doc_id, text, source FROM documents),
{LINE_STEPS}
SELECT d.doc_id, coalesce(c.n_lines, 0) AS n_lines, coalesce(c.n_removed, 0) AS n_removed,
       length(c.text) AS n_chars, sha256(c.text) AS text_sha256
FROM docs d LEFT JOIN line_done c ON d.doc_id = c.doc_id
"""
