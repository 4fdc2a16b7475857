"""The corpus pipeline: language ID, line dedup, n-gram Jaccard join, mixing, BPE round trip.

Each stage reads what its predecessor stored and returns a DataFrame; all but the last return the
columns of ``documents``.

- ``language_id`` drops documents that the identifier rejects (no letters, or far from all languages).
- ``line_dedup`` removes lines that many sites share from the texts and drops documents that lose all
  their lines by it; their lines stand in a document that stays. ``n_chars`` follows the text.
- ``near_dedup`` keeps the document with the smallest id of each group of linked texts; texts are linked
  that share four fifths of their runs of five words.
- ``mix`` repeats documents as the mix takes them: whole epochs first, then the chosen part; a document
  that the mix doesn't take goes, one taken twice has two rows. Documents without words have nothing to
  take and go.
- ``bpe`` encodes and decodes every text and returns ``doc_id, n_tokens, ids_sha256, decoded_sha256``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cobaltmill.llm import bpe, jaccard, langid, lines, mixing
from cobaltmill.session import materialise, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.learn(docs.filter(~langid.held_out(F.col("doc_id"))))
    return langid.identify(docs, model).filter(~F.col("rejected")).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = lines.line_dedup(docs)
    emptied = (F.col("n_removed") > 0) & (F.trim(F.regexp_replace("text", "[\\t\\r\\n]", " ")) == "")
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cleaned.filter(~F.coalesce(emptied, F.lit(False))).withColumn("n_chars", n_chars).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.near_dedup(docs, width=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.take(docs, mixing.mix_documents(docs, table(spark, sf_dir, "labels")))


def bpe_round_trip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.round_trip(docs.select("doc_id", "text"), bpe.default_path(), keep=["doc_id"]))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix", mix),
    ("bpe", bpe_round_trip),
]

#: Language ID and BPE have no SQL form; the tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every result but the last is stored and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, f"stage-{name}")
    return docs
