"""Issuer-prefix queries over prefixes made up from part keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cobaltmill.catalog.registry import register
from cobaltmill.functions import prefixes as X
from cobaltmill.operators import prefix_batch as B
from cobaltmill.session import table

# Invented texts: six and eight digit prefixes, too short and overlong ones, and letters. Several
# overlong ones of a store begin alike and stay apart.
_TEXT = """
CASE p_size % 6 WHEN 0 THEN '  ' || (390000 + (p_partkey * 37) % 130000) WHEN 1 THEN (39000000 + (p_partkey * 7919) % 13000000) || ''
  WHEN 2 THEN (p_partkey % 100000) || '' WHEN 3 THEN 'AB' || p_partkey
  WHEN 4 THEN (400000000 + p_partkey * 104729 % 100000000) || '' ELSE (300000 + p_partkey % 50000) || ' ' END
"""
_SQL = f"""
WITH t AS (SELECT p_brand AS store_id, trim({_TEXT}) AS typed FROM part),
r AS (SELECT DISTINCT store_id, typed AS prefix, false AS overlong FROM t WHERE length(typed) <= 8
      UNION ALL SELECT store_id, NULL, true FROM t WHERE length(typed) > 8),
f AS (SELECT *, coalesce(regexp_full_match(prefix, '[0-9]{{6,8}}'), false) AS format_ok FROM r),
d AS (SELECT *, CASE WHEN format_ok THEN list_sum([
         CASE WHEN i % 2 = 1 THEN (2 * CAST(substr(prefix, length(prefix) + 1 - i, 1) AS INT)) // 10
                                  + (2 * CAST(substr(prefix, length(prefix) + 1 - i, 1) AS INT)) % 10
              ELSE CAST(substr(prefix, length(prefix) + 1 - i, 1) AS INT) END
         FOR i IN range(1, length(prefix) + 1)]) % 10 = 0 ELSE false END AS checksum_ok FROM f),
c AS (SELECT *, CASE WHEN NOT format_ok THEN 'LOW' WHEN checksum_ok THEN 'HIGH' ELSE 'MEDIUM' END AS validation_level,
        CASE WHEN TRY_CAST(substr(prefix, 1, 6) AS INT) BETWEEN 400000 AND 499999 THEN 'US'
             WHEN TRY_CAST(substr(prefix, 1, 6) AS INT) BETWEEN 500000 AND 509999 THEN 'BR' ELSE 'UNKNOWN' END AS country,
        CASE left(prefix, 1) WHEN '4' THEN 'VISA' WHEN '5' THEN 'MASTERCARD' WHEN '3' THEN 'AMEX' ELSE 'UNKNOWN' END AS card_type
      FROM d)
"""


def rows(spark: SparkSession, sf: str) -> DataFrame:
    made = table(spark, sf, "part").select(F.col("p_brand").alias("store_id"), F.expr(_TEXT).alias("prefix"))
    return B.normalise(made)


@register("prefix_normalize", _SQL + "SELECT store_id, prefix, overlong FROM r")
def prefix_normalize(spark, sf):
    return rows(spark, sf)


@register("prefix_format", _SQL + "SELECT store_id, prefix, overlong, format_ok FROM f")
def prefix_format(spark, sf):
    return rows(spark, sf).withColumn("format_ok", X.format_ok(F.col("prefix")))


@register("prefix_checksum", _SQL + "SELECT store_id, prefix, overlong, checksum_ok FROM d")
def prefix_checksum(spark, sf):
    return rows(spark, sf).withColumn("checksum_ok", X.checksum_ok(F.col("prefix")))


@register("prefix_level", _SQL + "SELECT store_id, prefix, overlong, validation_level FROM c")
def prefix_level(spark, sf):
    return rows(spark, sf).withColumn("validation_level", X.level(F.col("prefix")))


@register("prefix_country", _SQL + "SELECT store_id, prefix, overlong, country FROM c")
def prefix_country(spark, sf):
    return rows(spark, sf).withColumn("country", X.country(F.col("prefix")))


@register("prefix_brand", _SQL + "SELECT store_id, prefix, overlong, card_type FROM c")
def prefix_brand(spark, sf):
    return rows(spark, sf).withColumn("card_type", X.brand(F.col("prefix")))


@register("prefix_classify", _SQL + "SELECT store_id, prefix, overlong, country, card_type, validation_level FROM c")
def prefix_classify(spark, sf):
    return B.classify(rows(spark, sf))


@register("store_summary", _SQL + """
SELECT store_id, country, card_type, count(*) AS prefix_count,
       round(100 * avg(CASE WHEN validation_level = 'HIGH' THEN 1.0 ELSE 0.0 END), 6) AS high_validation_percent
FROM c GROUP BY ALL
""")
def store_summary(spark, sf):
    summary = B.store_summary(B.classify(rows(spark, sf)))
    return summary.withColumn("high_validation_percent", F.round("high_validation_percent", 6))
