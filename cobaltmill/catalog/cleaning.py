"""Cleaning operators over dirty text that both engines derive from the stored tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cobaltmill.catalog.registry import register
from cobaltmill.functions import numbers as N
from cobaltmill.functions import text as T
from cobaltmill.functions import vocab
from cobaltmill.operators import cleaning as C
from cobaltmill.operators import fuzzy, headers
from cobaltmill.operators.ordering import locf
from cobaltmill.operators.profile import delimiter_density, id_profile
from cobaltmill.plans.clean import clean_files
from cobaltmill.session import table


def sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def sql_any(text: str, words) -> str:
    return f"list_bool_or([contains({text}, w) FOR w IN {sql_list(words)}])"


# --- text and blanks ----------------------------------------------------------------------------

@register("norm_text", rf"""
SELECT doc_id, md5(trim(regexp_replace(text, '[{T.SPACE}]+', ' ', 'g'))) AS digest,
       length(trim(regexp_replace(text, '[{T.SPACE}]+', ' ', 'g'))) AS n_chars
FROM documents
""")
def norm_text(spark, sf):
    clean = T.norm_text(F.col("text"))
    return table(spark, sf, "documents").select(
        "doc_id", F.md5(clean.cast("binary")).alias("digest"),
        F.length(clean).cast("long").alias("n_chars"),
    )


@register("blank_to_null_drop", """
WITH d AS (SELECT event_id, CASE WHEN event_type = 'view' THEN NULL ELSE event_type END AS kind,
                  CASE WHEN value < 8 THEN NULL ELSE trim(props) END AS props
           FROM events)
SELECT * FROM d WHERE kind IS NOT NULL OR props IS NOT NULL
""")
def blank_to_null_drop(spark, sf):
    dirty = table(spark, sf, "events").select(
        "event_id",
        F.when(F.col("event_type") == "view", " \t ").otherwise(F.col("event_type")).alias("kind"),
        F.when(F.col("value") < 8, "").otherwise(F.concat(F.lit("  "), "props")).alias("props"),
        F.lit("  ").alias("never_filled"),
    )
    cols = ["kind", "props", "never_filled"]
    return C.shape(C.normalise_cells(dirty, cols), cols)


@register("strip_accents", """
SELECT doc_id, md5(strip_accents(text)) AS digest FROM documents
""")
def strip_accents(spark, sf):
    plain = T.strip_accents(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.md5(plain.cast("binary")).alias("digest"))


# --- headers ------------------------------------------------------------------------------------

_PHRASES = {
    "view": "Informe mensual", "click": "Periodo 2024 DIAN 900123456-7", "purchase": "Fecha|NIT;Valor",
    "error": "descripcion, cantidad-valor total CIF/FOB", "signup": "",
}


def _raw_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's leading events as the leading rows of a raw file."""
    from cobaltmill.operators.ordering import first_n

    text = F.lit(None)
    for kind, phrase in _PHRASES.items():
        text = F.when(F.col("event_type") == kind, phrase).otherwise(text)
    events = table(spark, sf, "events").select("user_id", "ts", "event_id", text.alias("cell"), "props")
    ranked = first_n(events, ["user_id"], [F.col("ts"), F.col("event_id")], vocab.HEADER_SCAN_ROWS)
    return ranked.select(
        F.col("user_id").alias("file"), (F.col("rank") - 1).cast("long").alias("row_id"),
        F.array("cell", F.when(F.col("cell") != "", F.col("props"))).alias("cells"),
    )


_RAW_SQL = f"""
WITH raw AS (
  SELECT user_id AS file, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS row_id,
         CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _PHRASES.items())} END AS cell,
         CASE WHEN event_type <> 'signup' THEN props END AS extra
  FROM events QUALIFY row_id < 24),
scored AS (
  SELECT *, len(list_filter(
      regexp_split_to_array(lower(coalesce(cell, '')) || ' ' || lower(coalesce(extra, '')),
                            '[\\s|,;_\\-./\\\\()\\[\\]]+'),
      lambda t: list_contains({sql_list(vocab.HEADER_KEYWORDS)}, t))) AS score
  FROM raw),
best AS (
  SELECT file, arg_max(row_id, score * 100 - row_id) AS best_row, max(score) AS best_score,
         max(CASE WHEN row_id = 0 THEN score END) AS first_score
  FROM scored GROUP BY file),
header AS (
  SELECT file, CASE WHEN best_row > 0 AND best_score >= 2 AND best_score > first_score
                    THEN best_row ELSE 0 END AS header_row, best_score
  FROM best)
"""


@register("header_detect", _RAW_SQL + "SELECT * FROM header")
def header_detect(spark, sf):
    return headers.header_rows(_raw_rows(spark, sf))


@register("header_score_legacy", f"""
WITH raw AS (
  SELECT user_id AS file, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS row_id,
         lower(CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _PHRASES.items())} END) AS cell,
         CASE WHEN event_type <> 'signup' THEN lower(props) ELSE '' END AS extra
  FROM events QUALIFY row_id < 12),
scored AS (
  SELECT *, CAST(list_sum([CAST(contains(cell, w) AS INT) + CAST(contains(extra, w) AS INT)
             FOR w IN {sql_list(vocab.TRANSACTION_HEADER_KEYWORDS)}]) AS BIGINT) AS score
  FROM raw),
best AS (
  SELECT file, arg_max(row_id, score * 100 - row_id) AS best_row, max(score) AS best_score,
         max(CASE WHEN row_id = 0 THEN score END) AS first_score
  FROM scored GROUP BY file)
SELECT file, CASE WHEN best_row > 0 AND best_score >= 2 AND best_score > first_score
                  THEN best_row ELSE 0 END AS header_row, best_score
FROM best
""")
def header_score_legacy(spark, sf):
    return headers.header_rows(_raw_rows(spark, sf), mode="substring")


@register("dedupe_headers", """
WITH b AS (SELECT user_id AS file, event_id AS idx,
                  CASE event_type WHEN 'error' THEN 'col_' || (event_id + 1) WHEN 'view' THEN 'col_' || (event_id + 1)
                       WHEN 'click' THEN 'signup x_' || (1 + event_id % 5) ELSE event_type || ' x' END AS base FROM events),
h AS (SELECT file, list(DISTINCT base) AS held FROM b GROUP BY file),
r AS (SELECT b.*, held, row_number() OVER (PARTITION BY file, base ORDER BY idx) AS n FROM b JOIN h USING (file))
SELECT file, idx, CASE WHEN n = 1 THEN base ELSE base || '_' || list_filter(
         range(2, n + len(held) + 2), lambda k: NOT list_contains(held, base || '_' || k))[n - 1] END AS "column" FROM r
""")
def dedupe_headers(spark, sf):
    kind = F.col("event_type")
    name = F.when(kind == "error", " ").when(kind == "view", "NaN").when(
        kind == "click", F.concat(F.lit("signup x_"), (1 + F.col("event_id") % 5).cast("string"))
    ).otherwise(F.concat(kind, F.lit("   x ")))
    cells = table(spark, sf, "events").select(
        F.col("user_id").alias("file"), F.col("event_id").alias("idx"), name.alias("name"))
    return headers.dedupe_headers(cells)


@register("header_metadata", _RAW_SQL + """
SELECT raw.file, string_agg(
         CASE WHEN extra IS NULL THEN cell ELSE cell || ' | ' || extra END, chr(10) ORDER BY row_id
       ) AS metadata_text
FROM raw JOIN header USING (file) WHERE row_id < header_row AND cell <> '' GROUP BY raw.file
""")
def header_metadata(spark, sf):
    raw = _raw_rows(spark, sf)
    return headers.preamble_text(raw, headers.header_rows(raw))


STAMPED_SQL = """
WITH d AS (SELECT doc_id, source, CASE lang WHEN 'es' THEN 'Dian ' || text || ' NIT ' || lpad(CAST(doc_id AS VARCHAR), 9, '9') || '-K.'
             WHEN 'fr' THEN text || ' ' || lpad(CAST(doc_id AS VARCHAR), 8, '8') || '-77' ELSE text END AS text FROM documents)
"""


def stamped_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of two languages carry a declarant number, as an export's preamble would."""
    key = F.col("doc_id").cast("string")
    text = (
        F.when(F.col("lang") == "es", F.concat(F.lit("Dian "), "text", F.lit(" NIT "), F.lpad(key, 9, "9"), F.lit("-K.")))
        .when(F.col("lang") == "fr", F.concat("text", F.lit(" "), F.lpad(key, 8, "8"), F.lit("-77")))
        .otherwise(F.col("text"))
    )
    return table(spark, sf, "documents").select("doc_id", "source", text.alias("text"))


@register("metadata_extract", STAMPED_SQL + r"""
SELECT doc_id, CASE WHEN contains(lower(text), 'dian') THEN 'DIAN' ELSE '' END AS fuente,
       regexp_extract(text, '\b(\d{8,10}(?:-\w)?)\b', 1) AS nit_declarante
FROM d
""")
def metadata_extract(spark, sf):
    found = stamped_documents(spark, sf).select(
        "doc_id", headers.document_metadata(F.col("text")).alias("m"))
    return found.select("doc_id", "m.fuente", "m.nit_declarante")


# --- delimiters ---------------------------------------------------------------------------------

@register("delimiter_density", """
SELECT c AS "column", m AS mark, round(avg(CASE WHEN contains(v, m) THEN 1.0 ELSE 0.0 END), 6) AS density,
       avg(CASE WHEN contains(v, m) THEN 1.0 ELSE 0.0 END) >= 0.6 AS dense
FROM (SELECT unnest(['text', 'source']) AS c, unnest([text, source]) AS v FROM documents)
CROSS JOIN (SELECT unnest(['|', ';']) AS m) GROUP BY ALL
""")
def density(spark, sf):
    found = delimiter_density(table(spark, sf, "documents"), ["text", "source"])
    return found.withColumn("density", F.round("density", 6))


@register("expand_delimiters", """
SELECT o_orderkey,
       CASE WHEN o_orderstatus = 'P' THEN 'sin datos' ELSE o_orderstatus END AS detalle_p0,
       CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS detalle_p1,
       CASE WHEN o_orderstatus <> 'P' THEN CAST(o_custkey AS VARCHAR) END AS detalle_p2,
       CASE WHEN o_orderstatus = 'F' THEN o_orderpriority || ';x' ELSE o_orderpriority END AS nota
FROM orders
""")
def expand_delimiters(spark, sf):
    key = F.col("o_custkey").cast("string")
    merged = F.concat_ws(" | ", "o_orderstatus", "o_orderpriority", key)
    rows = table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "P", "sin datos").otherwise(merged).alias("detalle"),
        F.when(F.col("o_orderstatus") == "F", F.concat("o_orderpriority", F.lit(";x")))
        .otherwise(F.col("o_orderpriority")).alias("nota"),
    )
    return C.shape(rows, ["detalle", "nota"])


# --- identifiers and numbers --------------------------------------------------------------------

def _documents_of_customers(spark, sf) -> DataFrame:
    """Customer numbers written as tax ids in several ways."""
    digits = F.lpad(F.col("c_custkey").cast("string"), 9, "9")
    dotted = F.concat_ws(".", F.substring(digits, 1, 3), F.substring(digits, 4, 3), F.substring(digits, 7, 3))
    text = (
        F.when(F.col("c_mktsegment") == "BUILDING", F.concat(dotted, F.lit("-7")))
        .when(F.col("c_mktsegment") == "MACHINERY", F.concat(F.lit("  "), digits, F.lit(" ")))
        .when(F.col("c_mktsegment") == "HOUSEHOLD", F.concat(F.substring(digits, 1, 5), F.lit(" "), F.substring(digits, 6, 4)))
        .when(F.col("c_acctbal") < 0, "ABC")
        .otherwise(digits)
    )
    return table(spark, sf, "customer").select(
        "c_custkey", "c_name", F.col("c_acctbal").cast("string").alias("saldo"), text.alias("numero"),
        "c_mktsegment",
    )


_CUSTOMER_SQL = """
WITH d AS (SELECT *, lpad(CAST(c_custkey AS VARCHAR), 9, '9') AS g FROM customer),
c AS (SELECT c_custkey, c_name, CAST(c_acctbal AS VARCHAR) AS saldo, c_mktsegment,
        CASE WHEN c_mktsegment = 'BUILDING'
               THEN substr(g, 1, 3) || '.' || substr(g, 4, 3) || '.' || substr(g, 7, 3) || '-7'
             WHEN c_mktsegment = 'MACHINERY' THEN '  ' || g || ' '
             WHEN c_mktsegment = 'HOUSEHOLD' THEN substr(g, 1, 5) || ' ' || substr(g, 6, 4)
             WHEN c_acctbal < 0 THEN 'ABC' ELSE g END AS numero FROM d)
"""


@register("id_column_detect", _CUSTOMER_SQL + r"""
SELECT col AS "column", round(share, 6) AS id_share, share >= 0.7 AS is_id FROM (
  SELECT col, avg(CASE WHEN regexp_matches(regexp_replace(v, '[.,\s]', '', 'g'), '^\d{8,10}(-\w+)?$')
                       THEN 1.0 ELSE 0.0 END) AS share
  FROM (SELECT unnest(['c_name', 'saldo', 'numero']) AS col, unnest([c_name, saldo, numero]) AS v FROM c)
  GROUP BY col)
""")
def id_column_detect(spark, sf):
    found = id_profile(_documents_of_customers(spark, sf), ["c_name", "saldo", "numero"])
    return found.withColumn("id_share", F.round("id_share", 6))


@register("id_normalize", _CUSTOMER_SQL + r"""
SELECT c_custkey, CASE WHEN regexp_matches(t, '\d{8,10}') THEN regexp_extract(t, '(\d{8,10})', 1) ELSE t END AS id,
       regexp_replace(regexp_replace(replace(c_name, ' ', ''), '[.,]', '', 'g'), '-\w+$', '') AS name_id
FROM (SELECT *, regexp_replace(regexp_replace(trim(numero), '[., ]', '', 'g'), '-\w+$', '') AS t FROM c)
WHERE NOT regexp_matches(c_name, '\d{10}') AND NOT regexp_matches(c_name, '\d{8}')
UNION ALL
SELECT c_custkey, CASE WHEN regexp_matches(t, '\d{8,10}') THEN regexp_extract(t, '(\d{8,10})', 1) ELSE t END AS id,
       regexp_extract(c_name, '(\d{8,10})', 1) AS name_id
FROM (SELECT *, regexp_replace(regexp_replace(trim(numero), '[., ]', '', 'g'), '-\w+$', '') AS t FROM c)
WHERE regexp_matches(c_name, '\d{8}')
""")
def id_normalize(spark, sf):
    return _documents_of_customers(spark, sf).select(
        "c_custkey", N.id_normalize(F.col("numero")).alias("id"),
        N.id_normalize(F.col("c_name")).alias("name_id"),
    )


def _peso_texts(spark, sf) -> DataFrame:
    """Order totals written in the usual peso layouts."""
    cents = F.col("o_totalprice").cast("decimal(18,2)")
    whole = F.floor("o_totalprice").cast("long")
    dotted = F.translate(F.format_number(whole, 0), ",", ".")
    last2 = F.substring(cents.cast("string"), -2, 2)
    text = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("$ "), dotted))
        .when(F.col("o_orderpriority") == "2-HIGH", F.concat(dotted, F.lit(","), last2))
        .when(F.col("o_orderpriority") == "3-MEDIUM", cents.cast("string"))
        .when(F.col("o_orderpriority") == "5-LOW", F.format_number(whole, 0))
        .when(F.col("o_orderstatus") == "P", F.concat(last2, F.lit("-"), last2))
        .otherwise(F.concat(whole.cast("string"), F.lit(","), last2, F.lit(" COP")))
    )
    return table(spark, sf, "orders").select("o_orderkey", text.alias("txt"))


_PESO_SQL = r"""
WITH b AS (SELECT *, CAST(floor(o_totalprice) AS BIGINT) AS w,
                  right(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR), 2) AS l2 FROM orders),
t AS (SELECT o_orderkey,
        CASE WHEN o_orderpriority = '1-URGENT' THEN '$ ' || replace(format('{:,}', w), ',', '.')
             WHEN o_orderpriority = '2-HIGH' THEN replace(format('{:,}', w), ',', '.') || ',' || l2
             WHEN o_orderpriority = '3-MEDIUM' THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR)
             WHEN o_orderpriority = '5-LOW' THEN format('{:,}', w)
             WHEN o_orderstatus = 'P' THEN l2 || '-' || l2
             ELSE CAST(w AS VARCHAR) || ',' || l2 || ' COP' END AS txt FROM b),
s AS (SELECT *, regexp_replace(txt, '[^0-9,.\-]', '', 'g') AS s FROM t),
k AS (SELECT *, length(s) - length(replace(s, '.', '')) AS dots,
             length(s) - length(replace(s, ',', '')) AS commas FROM s),
v AS (SELECT *, CASE
        WHEN dots > 1 OR (dots = 1 AND commas >= 1) THEN replace(replace(s, '.', ''), ',', '.')
        WHEN dots = 1 AND regexp_full_match(s, '-?\d+\.\d{3}') THEN replace(s, '.', '')
        WHEN dots = 0 AND commas = 1 THEN replace(s, ',', '.')
        WHEN dots = 0 AND commas > 1 THEN replace(s, ',', '') ELSE s END AS n FROM k)
"""


@register("parse_cop", _PESO_SQL + "SELECT o_orderkey, txt, TRY_CAST(n AS DOUBLE) AS amount FROM v")
def parse_cop(spark, sf):
    return _peso_texts(spark, sf).withColumn("amount", N.parse_cop(F.col("txt")))


@register("parse_usd", r"""
SELECT l_returnflag, txt, TRY_CAST(replace(regexp_replace(txt, '[^0-9,.\-]', '', 'g'), ',', '') AS DOUBLE) AS amount
FROM (SELECT l_returnflag, CASE l_linestatus WHEN 'O' THEN 'US$ ' || format('{:,.2f}', l_extendedprice)
             ELSE CASE WHEN l_quantity < 2 THEN '-' ELSE format('{:,.2f}', l_extendedprice) END END AS txt
      FROM lineitem)
""")
def parse_usd(spark, sf):
    price = F.format_number("l_extendedprice", 2)
    text = (
        F.when(F.col("l_linestatus") == "O", F.concat(F.lit("US$ "), price))
        .when(F.col("l_quantity") < 2, "-").otherwise(price)
    )
    rows = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice").select(
        "l_returnflag", text.alias("txt"))
    return rows.withColumn("amount", N.parse_usd(F.col("txt")))


@register("typed_by_name", r"""
SELECT o_orderkey, lpad(CAST(o_custkey AS VARCHAR), 9, '8') AS nit_cliente, o_totalprice AS valor_usd,
       CAST(floor(o_totalprice) AS DOUBLE) AS valor_total, o_orderstatus AS estado
FROM orders
""")
def typed_by_name(spark, sf):
    digits = F.lpad(F.col("o_custkey").cast("string"), 9, "8")
    rows = table(spark, sf, "orders").select(
        "o_orderkey", F.concat(digits, F.lit("-K")).alias("nit_cliente"),
        F.concat(F.lit("US$ "), F.format_number("o_totalprice", 2)).alias("valor_usd"),
        F.translate(F.format_number(F.floor("o_totalprice"), 0), ",", ".").alias("valor_total"),
        F.col("o_orderstatus").alias("estado"),
    )
    cols = ["nit_cliente", "valor_usd", "valor_total", "estado"]
    ids = {r["column"] for r in id_profile(rows, cols).filter("is_id").collect()}
    return C.type_by_name(rows, cols, ids)


# --- catalogs -----------------------------------------------------------------------------------

_NAMES = ("Ciudad origen", "DEPARTAMENTO", "Zona Franca", "puerto", "Aduana", "Entidad bancaria", "Modalidad", "Total")


@register("catalog_for_column", f"""
WITH n AS (SELECT {sql_list(_NAMES)}[1 + p_size % 8] || ' ' || p_brand AS column_name FROM part)
SELECT column_name, count(*) AS n_parts, CASE {" ".join(
    f"WHEN {sql_any('lower(column_name)', words)} THEN '{catalog}'"
    for words, catalog in vocab.CATALOG_RULES)} END AS catalog
FROM n GROUP BY column_name
""")
def catalog_for_column(spark, sf):
    name = F.element_at(F.array(*[F.lit(n) for n in _NAMES]), 1 + F.col("p_size") % 8)
    names = table(spark, sf, "part").select(F.concat_ws(" ", name, "p_brand").alias("column_name"))
    counted = names.groupBy("column_name").agg(F.count(F.lit(1)).alias("n_parts"))
    return counted.withColumn("catalog", T.catalog_name(F.col("column_name")))


def _city_texts(spark, sf) -> DataFrame:
    """City names with wrong case, accents and lost letters, and texts that are no city."""
    cities = F.array(*[F.lit(c) for c in vocab.CATALOGS["ciudades"]])
    city = F.element_at(cities, (1 + F.col("c_custkey") % len(vocab.CATALOGS["ciudades"])).cast("int"))
    text = (
        F.when(F.col("c_mktsegment") == "BUILDING", F.lower(city))
        .when(F.col("c_mktsegment") == "MACHINERY", F.translate(city, "AEO", "ÁÉÓ"))
        .when(F.col("c_mktsegment") == "HOUSEHOLD", F.concat(F.lit(" "), F.substring(city, 1, 4), F.substring(city, 6, 40)))
        .when(F.col("c_mktsegment") == "AUTOMOBILE", F.col("c_name"))
        .when(F.col("c_custkey") % 5 == 0, "CLI").when(F.col("c_custkey") % 5 == 1, "Ibage")
        .when(F.col("c_custkey") % 5 == 2, "neva")
        .otherwise(city)
    )
    return table(spark, sf, "customer").select("c_custkey", text.alias("ciudad"))


_CITY_SQL = f"""
WITH c AS (SELECT c_custkey, c_name, c_mktsegment,
             {sql_list(vocab.CATALOGS["ciudades"])}[1 + c_custkey % {len(vocab.CATALOGS["ciudades"])}] AS city FROM customer),
d AS (SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN lower(city)
        WHEN 'MACHINERY' THEN translate(city, 'AEO', 'ÁÉÓ')
        WHEN 'HOUSEHOLD' THEN ' ' || substr(city, 1, 4) || substr(city, 6, 40)
        WHEN 'AUTOMOBILE' THEN c_name ELSE CASE c_custkey % 5 WHEN 0 THEN 'CLI' WHEN 1 THEN 'Ibage' WHEN 2 THEN 'neva' ELSE city END
        END AS ciudad FROM c),
u AS (SELECT DISTINCT ciudad, strip_accents(trim(upper(ciudad))) AS k FROM d),
s AS (SELECT ciudad, term, pos, 200 * (length(term) - bit_count(list_reduce(
               list_prepend((1::BIGINT << length(term)) - 1, list_transform(string_split(k, ''), lambda c: coalesce(list_sum(
                 [CASE WHEN substr(term, i, 1) = c THEN 1::BIGINT << (i - 1) ELSE 0 END FOR i IN range(1, length(term) + 1)]), 0)::BIGINT)),
               lambda v, m: ((v + (v & m)) | (v - (v & m))) & ((1::BIGINT << length(term)) - 1)))) // (length(k) + length(term)) AS score
      FROM u CROSS JOIN (SELECT unnest({sql_list(vocab.CATALOGS["ciudades"])}) AS term,
                                generate_subscripts({sql_list(vocab.CATALOGS["ciudades"])}, 1) AS pos)),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY ciudad ORDER BY score DESC, pos) = 1)
"""


@register("harmonize_fuzzy", _CITY_SQL + """
SELECT c_custkey, CASE WHEN score >= 85 THEN term ELSE d.ciudad END AS ciudad
FROM d LEFT JOIN b ON d.ciudad = b.ciudad
""")
def harmonize_fuzzy(spark, sf):
    return fuzzy.harmonize(_city_texts(spark, sf), "ciudad", "ciudades")


@register("fuzzy_best_terms", _CITY_SQL + "SELECT ciudad, term, CAST(score AS INTEGER) AS score FROM b")
def fuzzy_best_terms(spark, sf):
    return fuzzy.best_terms(_city_texts(spark, sf), "ciudad", "ciudades")


@register("fuzzy_weighted_terms")
def fuzzy_weighted_terms(spark, sf):
    return fuzzy.best_terms(_city_texts(spark, sf), "ciudad", "ciudades", "weighted")


# --- dates, gaps, quarantine --------------------------------------------------------------------

@register("date_coerce", """
SELECT o_orderkey, last_value(CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS TIMESTAMP) END IGNORE NULLS)
       OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS fecha
FROM orders
""")
def date_coerce(spark, sf):
    day = F.col("o_orderdate")
    text = (
        F.when(F.col("o_orderstatus") == "P", F.date_format(day, "yyyy.99.dd"))
        .when(F.col("o_orderpriority") == "1-URGENT", F.date_format(day, "d/M/yyyy"))
        .when(F.col("o_orderpriority") == "2-HIGH", F.date_format(day, "dd-MM-yyyy"))
        .when(F.col("o_orderpriority") == "3-MEDIUM", F.date_format(day, "dd/MM/yyyy HH:mm"))
    )
    layouts = ("yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss.SSS", "dd/MM/yy", "MMM d, yyyy",
               "yyyyMMdd", "d MMMM yyyy", "dd-MMM-yyyy")
    for i, layout in enumerate(layouts):
        text = text.when(F.col("o_orderkey") % len(layouts) == i, F.date_format(day, layout))
    rows = table(spark, sf, "orders").select("o_orderkey", text.alias("fecha"))
    return C.coerce_dates(rows, "o_orderkey", ["fecha"])


@register("numeric_quarantine", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_totalprice END AS valor,
       CASE WHEN o_orderpriority = '1-URGENT' THEN CAST(o_custkey AS VARCHAR) ELSE 'n/d' END AS precio
FROM orders
""")
def numeric_quarantine(spark, sf):
    cents = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    rows = table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "O", "abierto").otherwise(cents).alias("valor"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_custkey").cast("string"))
        .otherwise("n/d").alias("precio"),
    )
    return C.quarantine_numeric(rows, ["valor", "precio"])


@register("impute_additive", """
SELECT l_returnflag, count(*) AS n, count(*) FILTER (WHERE l_tax = 0) AS n_zero,
       CAST(sum(CAST(l_tax AS DECIMAL(18,2))) AS DOUBLE) AS impuesto
FROM lineitem GROUP BY l_returnflag
""")
def impute_additive(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        "l_returnflag", F.nullif("l_tax", F.lit(0.0)).alias("impuesto"))
    filled = C.impute_additive(rows, ["impuesto"])
    return filled.groupBy("l_returnflag").agg(
        F.count("impuesto").alias("n"), F.count_if(F.col("impuesto") == 0).alias("n_zero"),
        F.sum(F.col("impuesto").cast("decimal(18,2)")).cast("double").alias("impuesto"),
    )


@register("locf", """
SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER w AS value,
       last_value(CASE WHEN event_type = 'error' THEN props END IGNORE NULLS) OVER w AS props
FROM events WINDOW w AS (ORDER BY event_id ROWS UNBOUNDED PRECEDING)
""")
def locf_query(spark, sf):
    rows = table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_type") == "purchase", F.col("value")).alias("value"),
        F.when(F.col("event_type") == "error", F.col("props")).alias("props"),
    )
    return locf(rows, "event_id", ["value", "props"])


@register("locf_by_file", """
SELECT user_id, event_id, coalesce(last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS)
       OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 0) AS valor
FROM events
""")
def locf_by_file(spark, sf):
    rows = table(spark, sf, "events").select(
        "user_id", "event_id", F.when(F.col("event_type") == "purchase", F.col("value")).alias("valor"))
    return C.impute_forward(rows, "event_id", ["valor"], ["user_id"])


# --- the whole pipeline -------------------------------------------------------------------------

def _messy_exports(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as three raw files with a header each: in the third row below a preamble, in the first row
    with the columns in another order, and in the second row with a repeated name; then dirty cells."""
    day, key = F.col("o_orderdate"), F.lpad(F.col("o_custkey").cast("string"), 9, "9")
    cities = F.array(*[F.lit(c) for c in vocab.CATALOGS["ciudades"]])
    city = F.element_at(cities, (1 + F.col("o_custkey") % len(vocab.CATALOGS["ciudades"])).cast("int"))
    whole = F.floor("o_totalprice")
    cells = {
        "Fecha": F.when(F.col("o_orderstatus") == "P", "").otherwise(F.date_format(day, "dd/MM/yyyy")),
        "NIT": F.concat(key, F.lit("-1")),
        "Ciudad": F.initcap(F.translate(city, "AO", "ÁÓ")),
        "Valor COP": F.when(F.col("o_orderpriority") == "5-LOW", F.lit(None))
        .otherwise(F.translate(F.format_number(whole, 0), ",", ".")),
        "Flete": F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("")).otherwise((whole % 1000).cast("string")),
        "Vacía": F.lit(" "),
        "Tipo": F.concat_ws("|", "o_orderstatus", F.concat(F.lit(" "), "o_orderpriority")),
    }
    turned = list(cells)[::-1]
    repeated = ["NIT", "Valor COP", "Valor COP", "Fecha"]
    body = [F.array(*cells.values()), F.array(*[cells[c] for c in turned]),
            F.array(cells["NIT"], cells["Valor COP"], cells["Flete"], cells["Fecha"])]
    number = F.col("o_orderkey") % 3
    rows = table(spark, sf, "orders").select(
        F.concat(number.cast("string"), F.lit(".csv")).alias("file"), (F.col("o_orderkey") + 3).alias("row_id"),
        F.when(number == 0, body[0]).when(number == 1, body[1]).otherwise(body[2]).alias("cells"))
    top = [
        ("0.csv", 0, ["DIAN  informe 900123456-7", None, "", None, None, None, None]),
        ("0.csv", 1, ["Periodo 2024", "x", None, None, None, None, None]),
        ("0.csv", 2, list(cells)),
        ("1.csv", 0, turned),
        ("2.csv", 0, ["Otro informe", None, None, None]),
        ("2.csv", 1, repeated),
    ]
    head = spark.createDataFrame(top, "file string, row_id long, cells array<string>")
    return head.unionByName(rows)


_CLEAN_SQL = f"""
WITH b AS (
  SELECT (o_orderkey % 3) || '.csv' AS file, o_orderkey + 3 AS row_id, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS TIMESTAMP) END AS f,
         lpad(CAST(o_custkey AS VARCHAR), 9, '9') AS nit,
         {sql_list(vocab.CATALOGS["ciudades"])}[1 + o_custkey % {len(vocab.CATALOGS["ciudades"])}] AS ciudad,
         CASE WHEN o_orderpriority <> '5-LOW' THEN floor(o_totalprice) END AS v,
         CASE WHEN o_orderpriority <> '1-URGENT' THEN floor(o_totalprice) % 1000 END AS flete,
         o_orderstatus AS t0, o_orderpriority AS t1 FROM orders),
w AS (SELECT file, row_id, last_value(f IGNORE NULLS) OVER o AS "Fecha", nit AS "NIT",
        CASE WHEN file <> '2.csv' THEN ciudad END AS "Ciudad", coalesce(last_value(v IGNORE NULLS) OVER o, 0) AS "Valor COP",
        CASE WHEN file <> '2.csv' THEN CAST(coalesce(flete, 0) AS DOUBLE) END AS "Flete",
        CASE WHEN file <> '2.csv' THEN t0 END AS "Tipo_p0", CASE WHEN file <> '2.csv' THEN t1 END AS "Tipo_p1",
        CASE WHEN file = '2.csv' THEN CAST(coalesce(last_value(flete IGNORE NULLS) OVER o, 0) AS DOUBLE) END AS "Valor COP_2"
 FROM b WINDOW o AS (PARTITION BY file ORDER BY row_id ROWS UNBOUNDED PRECEDING))
"""


@register("clean_table", _CLEAN_SQL + "SELECT * FROM w")
def clean_table_query(spark, sf):
    tables = [done.table for done in clean_files(_messy_exports(spark, sf))]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


@register("clean_preview", _CLEAN_SQL + """
SELECT * EXCLUDE ("Valor COP_2"), CAST(2 AS BIGINT) AS header_row, true AS was_cleaned, 'DIAN' AS fuente, '900123456-7' AS nit_declarante
FROM w WHERE file = '0.csv' ORDER BY row_id LIMIT 5
""")
def clean_preview(spark, sf):
    preview = clean_files(_messy_exports(spark, sf), lead=5)[0].preview()
    return preview.select(
        *[c for c in preview.columns if c != "document_metadata"],
        "document_metadata.fuente", "document_metadata.nit_declarante",
    )


@register("classify_domain", f"""
SELECT doc_id, CASE WHEN {sql_any("lower(text)", vocab.COMPLIANCE_WORDS)}
                    THEN 'financial_compliance' ELSE 'general_analytics' END AS domain
FROM documents
""")
def classify_domain(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.domain_of_columns(F.col("text")).alias("domain"))
