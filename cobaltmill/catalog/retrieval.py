"""Vector index and search over the embeddings table."""

from __future__ import annotations

from pyspark.sql import functions as F

from cobaltmill.catalog.registry import register
from cobaltmill.operators import retrieval as R
from cobaltmill.operators.ordering import first_n
from cobaltmill.session import fresh_path, table
from cobaltmill.sources.sinks import append_index

_COS = "list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"


def _first_per_label(index):
    """One request per label: its vector with the smallest id."""
    return index.groupBy("label").agg(
        F.min("vec_id").alias("query_id"), F.min_by("embedding", "vec_id").alias("vector"))


@register("cosine_topk", f"""
SELECT e.vec_id, round({_COS}, 6) AS score
FROM embeddings e, (SELECT * FROM embeddings ORDER BY vec_id LIMIT 1) q
ORDER BY {_COS} DESC, e.vec_id LIMIT 5
""")
def cosine_topk(spark, sf):
    index = table(spark, sf, "embeddings")
    query = index.agg(F.min("vec_id").alias("query_id"), F.min_by("embedding", "vec_id").alias("vector"))
    return R.cosine_topk(index, query).select("vec_id", F.round("score", 6).alias("score"))


@register("cosine_topk_batch", f"""
SELECT q.vec_id AS query_id, e.vec_id, round({_COS}, 6) AS score,
       row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, e.vec_id) AS rank
FROM embeddings e, (SELECT * FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1) q
QUALIFY rank <= 5
""")
def cosine_topk_batch(spark, sf):
    index = table(spark, sf, "embeddings")
    found = R.cosine_topk(index, _first_per_label(index))
    return found.select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@register("tenant_scope", f"""
WITH e AS (SELECT vec_id, label, embedding FROM embeddings UNION ALL SELECT vec_id + 1000000, label, embedding[1:9] FROM embeddings),
q AS (SELECT vec_id, label, embedding FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= 3
      UNION ALL SELECT vec_id + 1000000, label, embedding[1:9] FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1)
SELECT q.vec_id AS query_id, e.label, e.vec_id, round({_COS}, 6) AS score
FROM e JOIN q ON e.label = q.label AND len(e.embedding) = len(q.embedding)
QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, e.vec_id) <= 5
""")
def tenant_scope(spark, sf):
    whole = table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    short = whole.select((F.col("vec_id") + 1000000).alias("vec_id"), "label", F.slice("embedding", 1, 9).alias("embedding"))

    def asked(index, n):
        return first_n(index, ["label"], [F.col("vec_id")], n).select(
            F.col("vec_id").alias("query_id"), "label", F.col("embedding").alias("vector"))

    found = R.tenant_topk(whole.unionByName(short), asked(whole, 3).unionByName(asked(short, 1)), "label")
    return found.select("query_id", "label", "vec_id", F.round("score", 6).alias("score"))


@register("index_append", """
SELECT label, 2 * count(*) AS n, CAST(2 * sum(len(embedding)) AS BIGINT) AS n_values FROM embeddings GROUP BY label
""")
def index_append(spark, sf):
    vectors, path = table(spark, sf, "embeddings"), fresh_path(spark, "index")
    append_index(vectors, path, "label")
    index = append_index(vectors, path, "label")
    return index.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.size("embedding")).alias("n_values"))
