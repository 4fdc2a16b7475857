"""Mix sources to target weights by weighted sampling without replacement.

Every row gets the key ``-ln(u) / weight`` with ``u`` drawn from a hash of its id, so a small key
is likelier for a heavy row (Efraimidis and Spirakis). A source repeats its rows in whole epochs
as often as its token target allows; the rest of the target takes the rows with the smallest keys
until their running sum of sizes meets it.

The sort within a source is a bucket sort: sums of sizes per source and key bucket find the bucket
where the running sum crosses the target, a second level of buckets divides only that one, and
exact order is needed only for the rows of one second-level bucket (1 / 2^24 of a source). A source
that holds most rows is therefore never sorted or collected in one place.

Defined results:

- null or wordless text: size 0, takes 0; a source of size 0 has target 0;
- null source: a source of its own, last in order; null id: hashed as the empty text;
- rows with one id share a key; order goes on by size and text, and equal rows are interchangeable;
- null, zero or negative weight counts as 1;
- an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cobaltmill.llm.common import WORD, free_names, word_count
from cobaltmill.operators.ordering import positions
from cobaltmill.session import materialise, table

BUCKETS = 4096
SOURCE_WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_EPOCHS = 2
SEED = "mix-1"


def draw(doc_id: Column, seed: str) -> Column:
    """A number in (0, 1] that depends on the id and the seed only."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 1) / F.lit(float(1 << 52))


def targets(rows: DataFrame, weights: tuple[int, ...] = SOURCE_WEIGHTS, share: float = SHARE,
            most_epochs: float = MOST_EPOCHS) -> DataFrame:
    """Token target of every source: ``source, source_size, target``.

    ``share`` of all sizes is dealt by weight; what exceeds ``most_epochs`` times a source's size
    is dealt again to the others by weight until no target is above. Each round is one aggregate;
    the driver sees its single row.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = positions(sizes, [F.col("source").asc_nulls_last()])
    listed = F.array(*[F.lit(float(w)) for w in weights])
    weight = F.element_at(listed, (F.col("position") % len(weights) + 1).cast("int"))
    known = materialise(
        ranked.select("source", "source_size", weight.alias("source_weight")), "mix-weights")
    most = F.col("source_size") * float(most_epochs)
    total = (known.agg(F.sum("source_size").alias("n")).first()["n"] or 0) * share
    level, capped = -1.0, 0
    while True:
        above = most <= F.col("source_weight") * level
        row = known.agg(
            F.count_if(above).alias("capped"),
            F.sum(F.when(above, most).otherwise(0.0)).alias("dealt"),
            F.sum(F.when(above, 0.0).otherwise(F.col("source_weight"))).alias("open"),
        ).first()
        if not row["open"] or (level >= 0 and row["capped"] == capped):
            break
        level, capped = (total - row["dealt"]) / row["open"], row["capped"]
    return known.select("source", "source_size",
                        F.least(most, F.col("source_weight") * max(level, 0.0)).alias("target"))


def _cut(sums: DataFrame, bucket: str, start: Column) -> DataFrame:
    """The bucket of each source in which the running sum passes ``rest``, and the sum before it."""
    running = Window.partitionBy("source").orderBy(bucket).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    summed = sums.withColumn("_to", start + F.sum("size").over(running))
    inside = (F.col("_to") - F.col("size") <= F.col("rest")) & (F.col("rest") < F.col("_to"))
    return summed.filter(inside).withColumn("_from", F.col("_to") - F.col("size"))


def mix(rows: DataFrame, goal: DataFrame, seed: str = SEED) -> DataFrame:
    """How often each row is taken: ``rows`` with columns doc_id, source, size, weight, text_hash.

    Adds ``source_size, target, sample_key, epochs`` (whole repeats), ``chosen`` (one repeat more)
    and ``taken`` (words). The row at which the running sum crosses the target is taken if that
    brings the sum nearer, so a source misses its target by half a document at most.
    """
    weight = F.when(F.col("weight") > 0, F.col("weight")).otherwise(F.lit(1.0))
    key = -F.log(draw(F.col("doc_id"), seed)) / weight
    spot = (F.lit(1.0) - F.exp(-F.col("sample_key"))) * BUCKETS
    stored = materialise(
        rows.select("doc_id", "source", "size", "text_hash", key.alias("sample_key"))
        .withColumn("_b1", F.least(F.floor(spot), F.lit(BUCKETS - 1)).cast("int"))
        .withColumn("_b2", F.least(F.floor((spot - F.col("_b1")) * BUCKETS),
                                   F.lit(BUCKETS - 1)).cast("int")),
        "mix-keys")
    full = F.floor(F.col("target") / F.col("source_size"))
    epochs = F.when(F.col("source_size") > 0, full).otherwise(F.lit(0)).cast("long")
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    facts = goal.withColumn("epochs", epochs).withColumn("rest", rest)

    def same(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        right = right.withColumnRenamed("source", "_source")
        return left.join(right, F.col("source").eqNullSafe(F.col("_source")), how).drop("_source")

    first = same(stored.groupBy("source", "_b1").agg(F.sum("size").alias("size")),
                 facts.select("source", "rest"), "inner")
    first = materialise(_cut(first, "_b1", F.lit(0)).select(
        "source", "rest", F.col("_b1").alias("_c1"), F.col("_from").alias("_f1")), "mix-cut")
    inside = same(stored, first, "inner").filter("_b1 = _c1")
    second = inside.groupBy("source", "rest", "_c1", "_f1", "_b2").agg(F.sum("size").alias("size"))
    second = _cut(second, "_b2", F.col("_f1")).select(
        "source", F.col("_c1"), F.col("_b2").alias("_c2"), F.col("_from").alias("_f2"))
    cuts = materialise(same(facts, second, "left"), "mix-cuts")

    joined = same(stored, cuts, "inner")
    at_cut = F.coalesce((F.col("_b1") == F.col("_c1")) & (F.col("_b2") == F.col("_c2")), F.lit(False))
    below = (F.col("_b1") < F.col("_c1")) | (
        (F.col("_b1") == F.col("_c1")) & (F.col("_b2") < F.col("_c2")))
    running = Window.partitionBy("source").orderBy("sample_key", "doc_id", "size", "text_hash").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    middle = F.col("_f2") + F.sum("size").over(running) - F.col("size") / 2
    decided = joined.filter(~at_cut).withColumn(
        "chosen", F.coalesce(below, F.lit(False)).cast("long"))
    crossing = joined.filter(at_cut).withColumn("chosen", (middle <= F.col("rest")).cast("long"))
    return decided.unionByName(crossing).select(
        "doc_id", "source", "size", "text_hash", "source_size", "target", "sample_key", "epochs", "chosen",
        (F.col("size") * (F.col("epochs") + F.col("chosen"))).alias("taken"))


def quality_weights(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, source, size, text_hash, weight``: labelled good weighs 2, labelled bad 0.5, else 1."""
    judged = labels.filter("doc_id is not null").groupBy("doc_id").agg(
        F.max("quality").alias("quality"))
    weight = F.when(F.col("quality") >= 1, 2.0).when(F.col("quality") < 1, 0.5).otherwise(1.0)
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"),
                        F.xxhash64("text").alias("text_hash"))
    return sized.join(judged, "doc_id", "left").select(
        "doc_id", "source", "size", "text_hash", weight.alias("weight"))


def mix_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rows = materialise(quality_weights(docs, labels), "mix-sizes")
    return mix(rows, targets(rows))


def take(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The rows of ``docs`` as often as ``mixed`` takes them.

    Of several rows with one id, source and text, those that come first in any order get what was chosen.
    """
    keys = ["doc_id", "source", "text_hash"]
    *mine, epochs, chosen, rows, number, copy = free_names(
        docs, *[f"mix_{k}" for k in keys], "epochs", "chosen", "rows", "taken", "copy")
    times = materialise(
        mixed.filter("size > 0").groupBy(*[F.col(k).alias(m) for k, m in zip(keys, mine)]).agg(
            F.max("epochs").alias(epochs), F.sum("chosen").alias(chosen), F.count(F.lit(1)).alias(rows))
        .filter(F.col(epochs) + F.col(chosen) > 0), "mix-times")
    same = (docs["doc_id"].eqNullSafe(F.col(mine[0])) & docs["source"].eqNullSafe(F.col(mine[1]))
            & (F.xxhash64(docs["text"]) == F.col(mine[2])))
    once = docs.join(times.filter(F.col(rows) == 1), same).withColumn(number, F.col(epochs) + F.col(chosen))
    alike = Window.partitionBy(*mine).orderBy(F.lit(0))
    more = docs.join(times.filter(F.col(rows) > 1), same).withColumn(
        number, F.col(epochs) + (F.row_number().over(alike) <= F.col(chosen)).cast("long"))
    both = once.unionByName(more).filter(F.col(number) > 0)
    return both.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(number)))).select(
        *[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "epochs", "chosen")


#: Named steps over a relation ``docs`` (doc_id, text, source), so that the pipeline can reuse them.
MIX_STEPS = rf"""
mix_judged AS (
  SELECT doc_id, max(quality) AS quality FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
mix_sized AS (
  SELECT d.doc_id, d.source,
         coalesce(len(regexp_extract_all(d.text, '{WORD}')), 0)::BIGINT AS size,
         -ln((('0x' || substr(md5('{SEED}:' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT
              ::DOUBLE + 1) / 4503599627370496.0)
         / CASE WHEN j.quality >= 1 THEN 2.0::DOUBLE WHEN j.quality < 1 THEN 0.5::DOUBLE
                ELSE 1.0::DOUBLE END AS sample_key
  FROM docs d LEFT JOIN mix_judged j ON d.doc_id = j.doc_id),
mix_sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         list_value(5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE)[
           ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT] AS w
  FROM mix_sized GROUP BY source),
mix_ratio AS (
  SELECT *, 2.0::DOUBLE * source_size / w AS ratio FROM mix_sources),
mix_open AS (
  SELECT *,
    (1.5::DOUBLE * (SELECT sum(source_size) FROM mix_ratio)::DOUBLE
     - coalesce(sum(2.0::DOUBLE * source_size) OVER below, 0.0::DOUBLE))
    / (sum(w) OVER (ORDER BY ratio RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS lev
  FROM mix_ratio
  WINDOW below AS (ORDER BY ratio RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP)),
mix_level AS (
  SELECT coalesce(arg_min(lev, ratio) FILTER (WHERE lev <= ratio), 0.0::DOUBLE) AS lev FROM mix_open),
mix_targets AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, w * lev) AS target,
    CASE WHEN source_size > 0
         THEN floor(least(2.0::DOUBLE * source_size, w * lev) / source_size)::BIGINT ELSE 0
    END AS epochs
  FROM mix_sources, mix_level),
mix_taken AS (
  SELECT s.doc_id, s.source, s.size, t.source_size, t.target, t.epochs,
    CASE WHEN sum(s.size) OVER (PARTITION BY s.source ORDER BY s.sample_key, s.doc_id, s.size
                                ROWS UNBOUNDED PRECEDING) - s.size / 2.0::DOUBLE
              <= t.target - t.epochs * t.source_size AND s.size > 0
         THEN 1 ELSE 0 END::BIGINT AS chosen
  FROM mix_sized s JOIN mix_targets t ON s.source IS NOT DISTINCT FROM t.source)
"""

SQL = f"""
WITH docs AS (SELECT doc_id, text, source FROM documents),
{MIX_STEPS}
SELECT doc_id, size, source_size, target, (size * (epochs + chosen))::BIGINT AS taken, epochs, chosen
FROM mix_taken
"""
