"""Text operators over documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from cobaltmill.catalog.cleaning import sql_any, sql_list
from cobaltmill.catalog.registry import register
from cobaltmill.functions import text as T
from cobaltmill.functions import vocab
from cobaltmill.operators import chunking
from cobaltmill.operators.aggregates import latest_n, oldest_first
from cobaltmill.operators.retrieval import context_assemble
from cobaltmill.session import table

def _strip(text: str) -> str:
    return f"regexp_replace({text}, '^[{T.SPACE}]+|[{T.SPACE}]+$', '', 'g')"


def _digest(c):
    return F.md5(c.cast("binary"))


_CHUNK_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_strip('text')} AS t FROM documents),
w AS (
  SELECT doc_id, t, 0 AS start, 0 AS stop, 0 AS covered, CAST(-1 AS BIGINT) AS i, '' AS chunk, false AS is_tail,
         length(t) AS n FROM d
  UNION ALL
  SELECT doc_id, t, next_start, stop, greatest(covered, stop), i + CASE WHEN chunk <> '' THEN 1 ELSE 0 END, chunk,
         covered >= n, n
  FROM (
    SELECT *, {_strip('substr(t, next_start + 1, stop - next_start)')} AS chunk FROM (
      SELECT doc_id, t, n, covered, i, next_start,
             CASE WHEN next_start + {vocab.CHUNK_CHARS} >= n THEN next_start + {vocab.CHUNK_CHARS}
                  WHEN regexp_matches(win, '\\n') THEN next_start + length(regexp_extract(win, '(?s)^.*\\n'))
                  WHEN contains(win, '. ') THEN next_start + length(regexp_extract(win, '(?s)^.*\\. ')) - 1
                  ELSE next_start + {vocab.CHUNK_CHARS} END AS stop
      FROM (
        SELECT *, substr(t, next_start + 1, {vocab.CHUNK_CHARS + 1}) AS win FROM (
          SELECT doc_id, t, n, covered, i,
                 CASE WHEN i = -1 AND stop = 0 THEN 0
                      WHEN stop - start > {vocab.CHUNK_OVERLAP} THEN stop - {vocab.CHUNK_OVERLAP}
                      ELSE stop END AS next_start
          FROM w) WHERE next_start < n)))),
chunks AS (SELECT doc_id, i AS chunk_index, chunk, is_tail FROM w WHERE chunk <> '')
"""


@register("chunk_text", _CHUNK_SQL + "SELECT doc_id, chunk_index, md5(chunk) AS digest, is_tail FROM chunks")
def chunk_text(spark, sf):
    chunks = chunking.chunk_text(table(spark, sf, "documents"), "doc_id", "text")
    return chunks.select("doc_id", "chunk_index", _digest(F.col("chunk")).alias("digest"), "is_tail")


_FIXED_SQL = """
WITH c AS (
  SELECT doc_id, s // 1300 AS chunk_index, substr(text, s + 1, 1500) AS chunk
  FROM (SELECT doc_id, text, unnest(range(0, length(text), 1300)) AS s FROM documents))
"""


@register("chunk_fixed", _FIXED_SQL + "SELECT doc_id, chunk_index, md5(chunk) AS digest FROM c")
def chunk_fixed(spark, sf):
    chunks = chunking.chunk_fixed(table(spark, sf, "documents"), "doc_id", "text")
    return chunks.select("doc_id", "chunk_index", _digest(F.col("chunk")).alias("digest"))


@register("batch_assign", _FIXED_SQL + """
SELECT doc_id, chunk_index // 20 AS batch, count(*) AS n_chunks, CAST(sum(length(chunk)) AS BIGINT) AS n_chars
FROM c GROUP BY ALL
""")
def batch_assign(spark, sf):
    chunks = chunking.chunk_fixed(table(spark, sf, "documents"), "doc_id", "text")
    return chunking.batch_assign(chunks).groupBy("doc_id", "batch").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.sum(F.length("chunk")).alias("n_chars"))


@register("context_assemble", f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id DESC) AS rank
           FROM documents QUALIFY rank <= 5),
e AS (SELECT source, rank, {_strip('text')} AS t FROM r)
SELECT source, md5(string_agg('[Fuente: ' || source || ']' || chr(10) || t,
         chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)) AS digest
FROM e WHERE t <> '' GROUP BY source
""")
def context(spark, sf):
    hits = latest_n(table(spark, sf, "documents"), ["source"], ["n_chars", "doc_id"], vocab.TOP_K)
    found = context_assemble(hits, ["source"], "rank", "source", "text")
    return found.select("source", _digest(F.col("context")).alias("digest"))


def _cap_sql(limit: int, room: int, note: str) -> str:
    cut = f"regexp_replace(substr(text, 1, {limit - room}), '[{T.SPACE}]+$', '')"
    note_sql = note.replace("\n", "' || chr(10) || '")
    return f"CASE WHEN length(text) <= {limit} THEN text ELSE {cut} || '{note_sql}' END"


@register("cap_text", f"""
SELECT doc_id, md5({_cap_sql(vocab.MESSAGE_LIMIT, 50, vocab.CAP_NOTE)}) AS answer,
       md5({_cap_sql(vocab.DIAGNOSTIC_LIMIT, 30, vocab.DIAGNOSTIC_NOTE)}) AS diagnostic FROM documents
""")
def cap_text(spark, sf):
    text = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", _digest(T.cap_text(text)).alias("answer"),
        _digest(T.cap_text(text, vocab.DIAGNOSTIC_LIMIT, 30, vocab.DIAGNOSTIC_NOTE)).alias("diagnostic"),
    )


@register("split_message", f"""
WITH RECURSIVE w AS (
  SELECT doc_id, CAST(-1 AS BIGINT) AS i, '' AS block, {_strip('text')} AS rest FROM documents
  UNION ALL
  SELECT doc_id, i + 1, block, regexp_replace(substr(rest, length(block) + 1), '^[{T.SPACE}]+', '') FROM (
    SELECT doc_id, i, rest, CASE
        WHEN length(rest) > {vocab.MESSAGE_LIMIT}
             AND length(regexp_extract(substr(rest, 1, {vocab.MESSAGE_LIMIT}), '(?s)^.*\\n')) - 1 > {vocab.MESSAGE_LIMIT // 2}
        THEN regexp_extract(substr(rest, 1, {vocab.MESSAGE_LIMIT}), '(?s)^.*\\n')
        ELSE substr(rest, 1, {vocab.MESSAGE_LIMIT}) END AS block
    FROM w WHERE rest <> ''))
SELECT doc_id, i AS chunk_index, md5(block) AS digest FROM w WHERE i >= 0
""")
def split_message(spark, sf):
    blocks = chunking.split_message(table(spark, sf, "documents"), "doc_id", "text")
    return blocks.select("doc_id", "chunk_index", _digest(F.col("chunk")).alias("digest"))


@register("extract_fenced", r"""
WITH c AS (SELECT conv_id, turn, CASE role WHEN 'assistant'
             THEN 'Código:' || chr(10) || '```python' || chr(10) || '¿' || text || chr(10) || '```' || ' fin'
             ELSE chr(65279) || '¡' || text || ' ```' END AS t FROM conversations),
b AS (SELECT conv_id, turn, CASE WHEN regexp_matches(t, '(?s)```python\s*(.*?)\s*```')
        THEN regexp_extract(t, '(?s)```python\s*(.*?)\s*```', 1) ELSE trim(replace(t, '```', '')) END AS body FROM c)
SELECT conv_id, turn, md5(replace(replace(ltrim(body, chr(65279) || chr(160)), '¡', '# '), '¿', '# ')) AS digest FROM b
""")
def extract_fenced(spark, sf):
    fenced = F.concat(F.lit("Código:\n```python\n¿"), "text", F.lit("\n``` fin"))
    bare = F.concat(F.lit("﻿¡"), "text", F.lit(" ```"))
    text = F.when(F.col("role") == "assistant", fenced).otherwise(bare)
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", _digest(T.extract_fenced(text)).alias("digest"))


@register("code_like", f"""
WITH c AS (SELECT conv_id, turn, CASE WHEN role = 'assistant'
             THEN '# ' || replace(text, chr(10), chr(10) || '# ') || chr(10) || '# read_csv' ||
                  CASE WHEN length(text) > 200 THEN chr(10) || '  df = pd.read_csv(x)' ELSE '' END
             ELSE text END AS t FROM conversations)
SELECT conv_id, turn, {sql_any('t', vocab.CODE_MARKS)} AND len(list_filter(string_split(t, chr(10)),
         lambda l: trim(l) <> '' AND NOT starts_with(ltrim(l), '#'))) > 0 AS is_code FROM c
""")
def code_like(spark, sf):
    tail = F.when(F.length("text") > 200, "\n  df = pd.read_csv(x)").otherwise("")
    commented = F.concat(
        F.lit("# "), F.replace("text", F.lit("\n"), F.lit("\n# ")), F.lit("\n# read_csv"), tail)
    text = F.when(F.col("role") == "assistant", commented).otherwise(F.col("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", T.code_like(text).alias("is_code"))


@register("extract_chart_json", r"""
WITH t AS (SELECT event_id, CASE event_type
    WHEN 'view' THEN 'a' || chr(10) || '```echarts-json' || chr(10) || '{"echarts_option": ' || props || '}' || chr(10) || '```'
    WHEN 'click' THEN '```ECHARTS-JSON ' || props || ' ``` b'
    WHEN 'purchase' THEN 'x' || chr(10) || '  ECHARTS_JSON_OUTPUT:{}' || chr(10) || 'ECHARTS_JSON_OUTPUT: ' || props || chr(10) || 'y'
    WHEN 'error' THEN '```echarts-json {"echarts_option": 3} ```' ELSE 'ECHARTS_JSON_OUTPUT:{"k": ' END AS t FROM events),
f AS (SELECT event_id, t, regexp_matches(t, '(?is)```echarts-json\s*(.*?)\s*```') AS fenced,
             regexp_extract(t, '(?is)```echarts-json\s*(.*?)\s*```', 1) AS body FROM t),
o AS (SELECT event_id, CASE WHEN fenced THEN
          CASE WHEN json_valid(body) THEN CASE WHEN json_exists(body, '$.echarts_option')
                 THEN json_extract(body, '$.echarts_option') ELSE body END END
        ELSE list_filter(list_transform(list_filter(string_split(t, chr(10)), lambda l: starts_with(trim(l), 'ECHARTS_JSON_OUTPUT:')),
               lambda l: trim(substr(trim(l), 21))), lambda j: json_valid(j) AND j <> '{}')[1] END AS option FROM f)
SELECT event_id, CAST(json_extract_string(option, '$.k') AS BIGINT) AS k FROM o
""")
def extract_chart_json(spark, sf):
    kind = F.col("event_type")
    text = (
        F.when(kind == "view", F.concat(F.lit('a\n```echarts-json\n{"echarts_option": '), "props", F.lit("}\n```")))
        .when(kind == "click", F.concat(F.lit("```ECHARTS-JSON "), "props", F.lit(" ``` b")))
        .when(kind == "purchase", F.concat(F.lit("x\n  ECHARTS_JSON_OUTPUT:{}\nECHARTS_JSON_OUTPUT: "), "props", F.lit("\ny")))
        .when(kind == "error", '```echarts-json {"echarts_option": 3} ```')
        .otherwise('ECHARTS_JSON_OUTPUT:{"k": ')
    )
    chart = T.chart_json(text)
    return table(spark, sf, "events").select(
        "event_id", F.try_variant_get(chart, "$.k", "bigint").alias("k"))


@register("json_from_text", r"""
WITH t AS (SELECT event_id, CASE event_type WHEN 'view' THEN '```json ' || props || ' ```'
    WHEN 'click' THEN 'Resultado: ' || props || ' listo' WHEN 'error' THEN '{"k": ' || props ELSE 'nada' END AS t FROM events),
j AS (SELECT event_id, regexp_extract(t, '(?s)\{.*\}') AS j FROM t)
SELECT event_id, CASE WHEN j <> '' AND json_valid(j) THEN CAST(json_extract_string(j, '$.k') AS BIGINT) END AS k FROM j
""")
def json_from_text(spark, sf):
    kind = F.col("event_type")
    text = (
        F.when(kind == "view", F.concat(F.lit("```json "), "props", F.lit(" ```")))
        .when(kind == "click", F.concat(F.lit("Resultado: "), "props", F.lit(" listo")))
        .when(kind == "error", F.concat(F.lit('{"k": '), "props")).otherwise("nada")
    )
    return table(spark, sf, "events").select(
        "event_id", F.try_variant_get(T.json_from_text(text), "$.k", "bigint").alias("k"))


_ASKS = ("¿Cuánto debo COMPRAR?", "Gráfica de barras", "resumen general", "Dashboard y pronóstico")
_ASK_SQL = "WITH c AS (SELECT conv_id, turn, text || ' ' || " + sql_list(_ASKS) + "[1 + (conv_id + turn) % 4] AS text FROM conversations)"


def _asks(spark, sf):
    """Conversation turns that end in one of four kinds of request."""
    asked = F.get(F.array(*[F.lit(a) for a in _ASKS]), ((F.col("conv_id") + F.col("turn")) % 4).cast("int"))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.concat_ws(" ", "text", asked).alias("text"))


@register("intent_route", _ASK_SQL + f"""
SELECT conv_id, turn, CASE WHEN {sql_any('lower(text)', vocab.PREDICTION_WORDS)}
       THEN 'prediction' ELSE 'analysis' END AS intent FROM c
""")
def intent_route(spark, sf):
    return _asks(spark, sf).select("conv_id", "turn", T.intent(F.col("text")).alias("intent"))


@register("chart_intent", _ASK_SQL + f"""
SELECT conv_id, turn, turn > 4 OR {sql_any('lower(text)', vocab.CHART_WORDS)} AS wants_chart FROM c
""")
def chart_intent(spark, sf):
    wanted = T.wants_chart(F.col("text"), F.col("turn") > 4)
    return _asks(spark, sf).select("conv_id", "turn", wanted.alias("wants_chart"))


@register("work_budget", _ASK_SQL + f"""
SELECT conv_id, turn, CAST(least(90 + CASE WHEN strlen(text) > 500 THEN 30 ELSE 0 END
       + CASE WHEN turn = 0 THEN 90 ELSE 0 END + CASE WHEN turn > 4 THEN 120 ELSE 0 END
       + CASE WHEN turn > 4 OR {sql_any('lower(text)', vocab.CHART_WORDS)} THEN 90 ELSE 0 END, 330) AS BIGINT) AS seconds
FROM c
""")
def work_budget(spark, sf):
    has_data = F.col("turn") > 4
    chart = T.wants_chart(F.col("text"), has_data)
    seconds = T.work_budget(F.col("text"), F.col("turn") == 0, has_data, chart)
    return _asks(spark, sf).select("conv_id", "turn", seconds.cast("long").alias("seconds"))


_FAILURES = ("HTTP 404 Not Found", "Deadline Exceeded", "429 quota", "API key INVALID", "sin clase", "no rate, 403")


@register("error_class", f"""
WITH d AS (SELECT doc_id, text || ' ' || {sql_list(_FAILURES)}[1 + doc_id % 6] AS text FROM documents)
SELECT doc_id, CASE {" ".join(f"WHEN {sql_any('lower(text)', words)} THEN '{name}'"
       for name, words in vocab.ERROR_CLASSES)} ELSE 'other' END AS error_class FROM d
""")
def error_class(spark, sf):
    failure = F.get(F.array(*[F.lit(m) for m in _FAILURES]), (F.col("doc_id") % 6).cast("int"))
    logged = F.concat_ws(" ", "text", failure)
    return table(spark, sf, "documents").select("doc_id", T.error_class(logged).alias("error_class"))


@register("report_style_block", """
SELECT c_custkey, md5('CONTRATO DE ESTILO ACTUAL:' || chr(10) || '- Perfil del stakeholder: ' || c_mktsegment || chr(10) ||
       '- Estilo de lenguaje: formal' || chr(10) || '- Dialecto / región: es-' || c_nationkey || chr(10) ||
       '- Color primario: #28468C | Secundario: #ff6d00' || chr(10) || '- Tamaños: cuerpo ' || (6 + c_custkey % 8) ||
       ' pt, títulos ' || (8 + c_custkey % 12) || ' pt' || chr(10)) AS digest FROM customer
""")
def report_style_block(spark, sf):
    block = T.style_block(
        F.col("c_mktsegment"), F.lit("formal"), F.concat(F.lit("es-"), F.col("c_nationkey").cast("string")),
        F.lit("#28468C"), F.lit("#ff6d00"), 6 + F.col("c_custkey") % 8, 8 + F.col("c_custkey") % 12,
    )
    return table(spark, sf, "customer").select("c_custkey", _digest(block).alias("digest"))


@register("history_last_n", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rank FROM conversations QUALIFY rank <= 20)
SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM r
""")
def history_last_n(spark, sf):
    last = oldest_first(table(spark, sf, "conversations"), ["conv_id"], ["turn"], 20)
    return last.select("conv_id", "turn", "role", F.col("position").cast("long").alias("position"))
