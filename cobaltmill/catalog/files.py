"""Sources and sinks. File logs are derived from the event table; written files are read back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cobaltmill.catalog.cleaning import STAMPED_SQL, stamped_documents
from cobaltmill.catalog.registry import register
from cobaltmill.functions import vocab
from cobaltmill.operators import aggregates as A
from cobaltmill.operators import charts, headers
from cobaltmill.session import fresh_path, table
from cobaltmill.sources import files, raw, sinks

_KINDS = {"purchase": "CSV", "view": "xlsx", "click": "xls", "error": "pdf", "signup": "md"}
_FILES_SQL = f"""
WITH f AS (SELECT user_id AS tenant, ts AS modified, 'data/' || user_id || '/' ||
             CASE WHEN value < 5 THEN '.' ELSE '' END || 'f' || event_id || '.' ||
             CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _KINDS.items())} END AS path
           FROM events)
"""


def _file_log(spark: SparkSession, sf: str) -> DataFrame:
    """Uploads of each user: one file per event, hidden when its value is small."""
    ext = F.lit(None).cast("string")
    for kind, name in _KINDS.items():
        ext = F.when(F.col("event_type") == kind, name).otherwise(ext)
    hidden = F.when(F.col("value") < 5, ".").otherwise("")
    path = F.concat(
        F.lit("data/"), F.col("user_id").cast("string"), F.lit("/"), hidden, F.lit("f"),
        F.col("event_id").cast("string"), F.lit("."), ext,
    )
    return table(spark, sf, "events").select(
        F.col("user_id").alias("tenant"), path.alias("path"), F.col("ts").alias("modified"))


@register("latest_file", _FILES_SQL + """
SELECT tenant, path, modified FROM f WHERE regexp_matches(lower(path), '\\.(csv|xlsx|xls)$')
QUALIFY row_number() OVER (PARTITION BY tenant ORDER BY modified DESC, path DESC) = 1
""")
def latest_file(spark, sf):
    return files.latest_file(_file_log(spark, sf))


@register("file_inventory", _FILES_SQL + """
SELECT tenant,
       bool_or(NOT contains(path, '/.') AND regexp_matches(lower(path), '\\.(csv|xlsx|xls|pdf|docx|txt)$')) AS has_data,
       count(*) FILTER (WHERE path LIKE '%.pdf') AS n_pdf, count(*) FILTER (WHERE regexp_matches(lower(path), '\\.(csv|xlsx|xls)$')) AS n_data,
       CAST(0 AS BIGINT) AS n_document, count(*) FILTER (WHERE path LIKE '%.md') AS n_other
FROM f GROUP BY tenant
""")
def file_inventory(spark, sf):
    return files.file_inventory(_file_log(spark, sf))


@register("mime_audit", """
WITH f AS (
  SELECT 'p/' || page_id || '.txt' AS path, html AS t FROM pages
  UNION ALL SELECT 'd/' || doc_id || '.csv', text FROM documents
  UNION ALL SELECT 'e/' || event_id || '.PDF', CASE WHEN value > 10 THEN '%PDF-1.4 ' || props ELSE props END FROM events
  UNION ALL SELECT 'x/' || event_id || CASE event_type WHEN 'view' THEN '.csv' WHEN 'click' THEN '.txt' WHEN 'error' THEN '.docx' ELSE '.xlsx' END,
    CASE event_type WHEN 'view' THEN 'MZ' || chr(1) || props WHEN 'click' THEN props || chr(2) WHEN 'signup' THEN 'PK' || chr(3) || chr(4) || 'xl/'
      ELSE 'PK' || chr(3) || chr(4) || props END FROM events),
m AS (SELECT path, CASE WHEN starts_with(t, '%PDF') THEN 'application/pdf'
        WHEN starts_with(t, 'PK' || chr(3) || chr(4) || 'xl/') THEN 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet'
        WHEN starts_with(t, 'PK' || chr(3) || chr(4)) THEN 'application/zip'
        WHEN starts_with(t, 'MZ') THEN 'application/vnd.microsoft.portable-executable'
        WHEN contains(substr(t, 1, 4000), chr(2)) THEN 'application/octet-stream'
        WHEN starts_with(ltrim(lower(t)), '<!doctype html') OR starts_with(ltrim(lower(t)), '<html') THEN 'text/html'
        WHEN starts_with(ltrim(t), '{') THEN 'application/json' ELSE 'text/plain' END AS mime, strlen(t) AS size FROM f)
SELECT path, mime, CASE WHEN path LIKE '%.PDF' THEN mime = 'application/pdf' WHEN path LIKE '%.docx' THEN mime LIKE '%wordprocessingml%'
         WHEN path LIKE '%.xlsx' THEN mime LIKE '%spreadsheetml%' OR mime = 'application/zip' ELSE mime = 'text/plain' END AS mime_ok,
       size <= 33554432 AS size_ok FROM m
""")
def mime_audit(spark, sf):
    def rows(name, folder, key, ext, content):
        path = F.concat(F.lit(folder), F.col(key).cast("string"), F.lit(ext) if isinstance(ext, str) else ext)
        return table(spark, sf, name).select(path.alias("path"), content.cast("binary").alias("content"))

    signed = F.when(F.col("value") > 10, F.concat(F.lit("%PDF-1.4 "), "props")).otherwise(F.col("props"))
    kind, zip_mark = F.col("event_type"), F.lit("PK\x03\x04")
    named = F.when(kind == "view", ".csv").when(kind == "click", ".txt").when(kind == "error", ".docx").otherwise(".xlsx")
    disguised = (
        F.when(kind == "view", F.concat(F.lit("MZ\x01"), "props")).when(kind == "click", F.concat("props", F.lit("\x02")))
        .when(kind == "signup", F.concat(zip_mark, F.lit("xl/"))).otherwise(F.concat(zip_mark, "props")))
    uploads = (
        rows("pages", "p/", "page_id", ".txt", F.col("html"))
        .unionByName(rows("documents", "d/", "doc_id", ".csv", F.col("text")))
        .unionByName(rows("events", "e/", "event_id", ".PDF", signed))
        .unionByName(rows("events", "x/", "event_id", named, disguised))
    )
    return files.upload_check(uploads).drop("content")


@register("delimiter_sniff", """
WITH l AS (SELECT doc_id AS file, unnest(string_split(text, chr(10))) AS line FROM documents),
c AS (SELECT file, pos, sep, length(line) - length(replace(line, sep, '')) AS n
      FROM l CROSS JOIN (VALUES (0, ','), (1, ';'), (2, '|'), (3, chr(9))) AS s(pos, sep) WHERE line <> ''),
s AS (SELECT file, pos, sep, count(*) * sum(n * n) - sum(n) * sum(n) AS spread, sum(n) >= count(*) AS usable
      FROM c GROUP BY ALL)
SELECT file, coalesce(arg_min(sep, (spread, pos)) FILTER (WHERE usable), ',') AS sep FROM s GROUP BY file
""")
def delimiter_sniff(spark, sf):
    lines = table(spark, sf, "documents").select(
        F.col("doc_id").alias("file"), F.explode(F.split("text", "\n")).alias("line"))
    return raw.file_facts(lines).select("file", "sep")


@register("raw_scan", """
SELECT CAST(c_custkey AS VARCHAR) AS c0,
       CASE WHEN c_mktsegment = 'BUILDING' THEN c_name || '; S.A.' ELSE c_name END AS c1,
       CAST(c_nationkey AS VARCHAR) AS c2, c_mktsegment || ' ñ' AS c3, 'utf-8' AS encoding
FROM customer
""")
def raw_scan(spark, sf):
    name = F.when(F.col("c_mktsegment") == "BUILDING", F.concat("c_name", F.lit("; S.A."))).otherwise(F.col("c_name"))
    path = fresh_path(spark, "export")
    table(spark, sf, "customer").select(
        "c_custkey", name.alias("name"), "c_nationkey", F.concat("c_mktsegment", F.lit(" ñ")).alias("segment")
    ).write.option("sep", ";").csv(path)
    scanned = raw.raw_scan(spark, path)
    return scanned.select(*[F.get("cells", F.lit(i)).alias(f"c{i}") for i in range(4)], "encoding")


@register("schema_sample", """
WITH s AS (SELECT * FROM orders ORDER BY o_orderkey LIMIT 2),
r AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS n,
        unnest(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_orderpriority']) AS "column",
        unnest(['bigint', 'bigint', 'string', 'string']) AS type,
        unnest([CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), o_orderstatus, o_orderpriority]) AS v FROM s)
SELECT "column", type, max(CASE WHEN n = 1 THEN v END) AS sample_1, max(CASE WHEN n = 2 THEN v END) AS sample_2
FROM r GROUP BY ALL
""")
def schema_sample(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return raw.schema_sample(rows, [F.col("o_orderkey")])


@register("bounded_read", """
(SELECT 'first' AS reading, o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 700)
UNION ALL SELECT 'all', o_orderkey, o_orderstatus FROM orders
""")
def bounded_read(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    first = raw.bounded_read(orders, "o_orderkey", 700).withColumn("reading", F.lit("first"))
    return first.unionByName(raw.bounded_read(orders, "o_orderkey").withColumn("reading", F.lit("all")))


@register("text_scan", """
SELECT doc_id, md5(text || chr(65533)) AS digest, length(text) + 1 AS n_chars FROM documents
""")
def text_scan(spark, sf):
    # Files of several documents each, with control characters between them and one byte that is no utf-8.
    path = fresh_path(spark, "texts")
    damaged = F.concat(F.encode("text", "utf-8"), F.unhex(F.lit("FF"))).cast("string")
    table(spark, sf, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit("\x1f"), damaged).alias("value")).write.option(
        "lineSep", "\x1e").text(path)
    parts = files.text_scan(spark, path).select(F.explode(F.split("text", "\x1e")).alias("part")).filter("part != ''")
    key, text = F.substring_index("part", "\x1f", 1), F.substring_index("part", "\x1f", -1)
    return parts.select(key.cast("long").alias("doc_id"), F.md5(text.cast("binary")).alias("digest"),
                        F.length(text).cast("long").alias("n_chars"))


@register("webhook_log_scan", """
SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY k
""")
def webhook_log_scan(spark, sf):
    path = fresh_path(spark, "log")
    table(spark, sf, "events").select(F.col("props").alias("value")).write.text(path)
    field = F.get_json_object("body", "$.k").try_cast("long").alias("k")
    return files.json_log_scan(spark, path).groupBy(field).agg(F.count(F.lit(1)).alias("n"))


@register("write_records", """
SELECT unnest(['csv', 'json', 'parquet']) AS format, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS key_sum,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders
""")
def write_records(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    folder = fresh_path(spark, "records")
    parts = []
    for fmt in ("csv", "json", "parquet"):
        back = sinks.write_records(rows, f"{folder}/{fmt}", fmt)
        parts.append(back.agg(
            F.lit(fmt).alias("format"), F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("key_sum"),
            F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"),
        ))
    return reduce(DataFrame.unionByName, parts)


@register("sidecar_write", STAMPED_SQL + r"""
SELECT source, doc_id, CASE WHEN contains(lower(text), 'dian') THEN 'DIAN' ELSE '' END AS fuente,
       regexp_extract(text, '\b(\d{8,10}(?:-\w)?)\b', 1) AS nit_declarante
FROM d
""")
def sidecar_write(spark, sf):
    metadata = stamped_documents(spark, sf).select(
        "source", "doc_id", headers.document_metadata(F.col("text")).alias("document_metadata"))
    back = sinks.write_sidecar(metadata, fresh_path(spark, "sidecar"), "source")
    return back.select(
        "source", "doc_id", "document_metadata.fuente", "document_metadata.nit_declarante")


@register("chart_spec_write", """
SELECT title, string_agg(label, '|' ORDER BY pos, label) AS labels, string_agg(CAST(n AS VARCHAR), '|' ORDER BY pos, label) AS points FROM (
  SELECT 'Distribución por estado' AS title, 0 AS pos, o_orderstatus AS label, count(*) AS n FROM orders GROUP BY ALL
  UNION ALL SELECT 'Distribución por prioridad', 0, o_orderpriority, count(*) FROM orders GROUP BY ALL
  UNION ALL SELECT 'Distribución por mes', month(o_orderdate), list_extract(['enero', 'febrero', 'marzo', 'abril', 'mayo', 'junio',
    'julio', 'agosto', 'septiembre', 'octubre', 'noviembre', 'diciembre'], month(o_orderdate)), count(*) FROM orders GROUP BY ALL) GROUP BY title
""")
def chart_spec_write(spark, sf):
    names = F.array(*[F.lit(m) for m in vocab.MONTHS_ES])
    orders = table(spark, sf, "orders").withColumn("mes", F.element_at(names, F.month("o_orderdate")))
    specs = [
        charts.option_json(charts.bar(A.group_by(orders, key), key, "value"), "bar", f"Distribución por {name}")
        for key, name in (("o_orderstatus", "estado"), ("o_orderpriority", "prioridad"), ("mes", "mes"))
    ]
    broken = orders.agg(F.lit(0).cast("long").alias("block"), F.concat(F.lit("{"), F.max("o_orderstatus")).alias("spec"))
    written = sinks.write_chart_specs(reduce(DataFrame.unionByName, [*specs, broken]), fresh_path(spark, "charts"))
    data = F.try_variant_get("spec", "$.series[0].data", "array<bigint>").cast("array<string>")
    return written.select(
        F.try_variant_get("spec", "$.title.text", "string").alias("title"),
        F.array_join(F.try_variant_get("spec", "$.xAxis.data", "array<string>"), "|").alias("labels"),
        F.array_join(data, "|").alias("points"),
    )


_PART = ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")


@register("report_bundle", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", least(greatest(max(length(CAST({c} AS VARCHAR))), {len(c)}) + 2, 60) AS width, count({c}) AS filled FROM part"
    for c in _PART
))
def report_bundle(spark, sf):
    parts = table(spark, sf, "part")
    summary = parts.agg(F.format_string("%d parts", F.count(F.lit(1))).alias("value"))
    _, widths = sinks.write_report(parts, fresh_path(spark, "report"), summary)
    return widths


