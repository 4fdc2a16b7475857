"""Order-independent document fingerprints by a homomorphic multiset hash, DataFrame functions only.

A text is a multiset of paragraphs; here these are cut at line feeds and also after sentences, and
stripped. Each paragraph is hashed to a wide vector of ``LANES`` lanes; the fingerprint is the number
of paragraphs and the sum of their vectors, three lanes of 20 bits packed into a number modulo 2^60.
So the fingerprint of a union is the sum of fingerprints: paragraphs are inserted by adding and deleted
by subtracting vectors, in any order. Equal multisets have equal fingerprints.

Lanes are sums of uniform bytes. Centred on their mean, two vectors have a cosine that estimates the
share of common paragraphs (error about ``1 / sqrt(LANES)``); negative values count as 0.

Defined results:

- null text: as the empty text, which has no paragraphs; blank paragraphs don't count;
- likeness is 1 for equal fingerprints, also for two empty ones, and 0 if only one is empty;
- order of documents: descending id, null ids last, then by hash of the text; repeated rows follow each
  other; the only document is its own next;
- an empty table gives no rows; other columns are ignored by ``edit_with_next`` and pass ``fingerprints``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cobaltmill.operators.ordering import positions
from cobaltmill.session import materialise, table

SEEDS = 8
SLOT = 20
MODULUS = (1 << 3 * SLOT) - 1
LANES = SEEDS * 6
PARAGRAPH = "(?<=\\n)|(?<=[.!?] )"


def paragraphs(text: Column) -> Column:
    cut = F.split(F.coalesce(text, F.lit("")), PARAGRAPH, -1)
    return F.filter(F.transform(cut, lambda p: F.btrim(p, F.lit(" \t\r\n"))), lambda p: p != "")


def _packed(h: Column, skip: int) -> Column:
    """Three bytes of a hash in slots of their own."""
    lanes = [F.shiftleft(F.shiftrightunsigned(h, skip + 8 * k).bitwiseAND(F.lit(255).cast("long")), SLOT * k)
             for k in range(3)]
    return reduce(Column.bitwiseOR, lanes)


def multiset_hash(items: Column) -> Column:
    """Number of items and packed sums, as an array; ``items`` should be a column of its own."""
    def summed(hashes: Column, skip: int) -> Column:
        return F.aggregate(hashes, F.lit(0).cast("long"), lambda total, h: (
            total + _packed(h, skip)).bitwiseAND(F.lit(MODULUS)))

    def hashed(seed: int) -> Column:
        return F.transform(items, lambda p: F.xxhash64(F.lit(seed), p))

    sums = [summed(hashed(seed), skip) for seed in range(SEEDS) for skip in (0, 24)]
    return F.array(F.size(items).cast("long"), *sums)


def fingerprints(docs: DataFrame, text: Column, name: str = "sums") -> DataFrame:
    """``docs`` with the multiset hash of a text as an array."""
    cut = docs.withColumn("_paragraphs", paragraphs(text))
    return cut.withColumn(name, multiset_hash(F.col("_paragraphs"))).drop("_paragraphs")


def _combine(a: Column, b: Column, sign: int) -> Column:
    # the count stays far below the modulus, so it may be treated like the sums
    return F.zip_with(a, b, lambda x, y: (x + F.lit(sign).cast("long") * y).bitwiseAND(F.lit(MODULUS)))


def insert(sums: Column, more: Column) -> Column:
    """The hash of a multiset after adding the paragraphs of another."""
    return _combine(sums, more, 1)


def delete(sums: Column, less: Column) -> Column:
    """The hash of a multiset after removing paragraphs that it holds."""
    return _combine(sums, less, -1)


def as_text(sums: Column) -> Column:
    return F.array_join(F.transform(sums, lambda x: F.lpad(F.lower(F.hex(x)), 3 * SLOT // 4, "0")), "")


def _lanes(sums: Column) -> Column:
    """Lanes doubled and centred on 0: ``2 lane - 255 n`` modulo 2^(SLOT + 1), taken as signed."""
    n, packed = F.get(sums, F.lit(0)), F.slice(sums, 2, 2 * SEEDS)

    def centred(x: Column, k: int) -> Column:
        lane = F.shiftright(x, SLOT * k).bitwiseAND(F.lit((1 << SLOT) - 1).cast("long"))
        wrapped = F.pmod(2 * lane - 255 * n + F.lit(1 << SLOT), F.lit(2 << SLOT).cast("long"))
        return (wrapped - F.lit(1 << SLOT)).cast("double")

    return F.flatten(F.transform(packed, lambda x: F.array(*[centred(x, k) for k in range(3)])))


def likeness(rows: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """Adds the likeness of two hashes, 0 to 1."""
    def total(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p * q)
        return F.aggregate(products, F.lit(0.0), lambda s, p: s + p)

    lanes = rows.withColumns({"_a": _lanes(F.col(a)), "_b": _lanes(F.col(b))})
    lanes = lanes.withColumns({
        "_dot": total(F.col("_a"), F.col("_b")),
        "_norm": F.sqrt(total(F.col("_a"), F.col("_a")) * total(F.col("_b"), F.col("_b")))})
    cosine = F.when(F.col("_norm") > 0, F.least(F.greatest(F.col("_dot") / F.col("_norm"), F.lit(0.0)),
                                                F.lit(1.0))).otherwise(F.lit(0.0))
    return lanes.withColumn(name, F.when(F.col(a) == F.col(b), F.lit(1.0)).otherwise(cosine)).drop(
        "_a", "_b", "_dot", "_norm")


def edit_with_next(docs: DataFrame) -> DataFrame:
    """Every document with its edited text and the hashes of both and of the next document.

    The last floor(n / 2) code points are replaced by the first as many (or all) of the next document.
    Only ids and hashes are ordered; each text is shuffled once by its key (equal rows are one there),
    and of the next document's text just the prefix that is needed goes to its predecessor. Of equal
    rows all but the last are followed by an equal row.

    Returns ``doc_id, text, n_chars, edited, sums, next_id, next_sums``.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keys = ["k1", "k2"]
    keyed = docs.select("doc_id", text.alias("text"), F.xxhash64("doc_id", text).alias("k1"),
                        F.xxhash64(F.lit(7), F.col("doc_id"), text).alias("k2"))
    narrow = keyed.groupBy("doc_id", *keys, F.length("text").alias("n")).agg(F.count(F.lit(1)).alias("copies"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("k1"), F.col("k2")]
    placed = materialise(positions(narrow, order), "next-places")
    count = max(placed.count(), 1)
    owner = placed.select(((F.col("position") + 1) % count).alias("_at"), "copies",
                          F.floor(F.col("n") / 2).cast("int").alias("take"), *[F.col(k).alias(f"o{k}") for k in keys])
    links = placed.drop("copies").join(owner, F.col("position") == F.col("_at")).select(
        *keys, "copies", "take", *[f"o{k}" for k in keys])
    links = materialise(links, "next-links")

    rows = fingerprints(keyed, F.col("text")).dropDuplicates(keys)
    after = rows.join(links, keys).select(
        *[F.col(f"o{k}").alias(k) for k in keys], "copies", "take", F.col("doc_id").alias("next_id"),
        F.substring(F.col("text"), F.lit(1), F.col("take")).alias("prefix"), F.col("sums").alias("next_sums"))
    n, copy = F.length("text"), F.col("_copy")
    each = rows.join(after, keys).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))

    def last(of_next: Column, of_itself: Column) -> Column:
        return F.when(copy == 1, of_next).otherwise(of_itself)

    head = F.substring(F.col("text"), F.lit(1), n - F.col("take"))
    own = F.substring(F.col("text"), F.lit(1), F.col("take"))
    return each.select(
        "doc_id", "text", n.cast("long").alias("n_chars"), F.concat(head, last(F.col("prefix"), own)).alias("edited"),
        "sums", last(F.col("next_id"), F.col("doc_id")).alias("next_id"),
        last(F.col("next_sums"), F.col("sums")).alias("next_sums"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = edit_with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))
    both = fingerprints(docs.drop("text"), F.col("edited"), "edited_sums")
    both = both.withColumn("edited_sha256", F.sha2("edited", 256)).drop("edited")
    both = likeness(likeness(both, "sums", "edited_sums", "near_edited"), "sums", "next_sums", "near_next")
    return both.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("sums")).alias("fingerprint"),
                       as_text(F.col("edited_sums")).alias("edited_fingerprint"), "near_edited", "near_next",
                       "next_id")
