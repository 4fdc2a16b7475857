"""Payment log queries. Bodies are written from the order table, the same way in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cobaltmill.catalog.registry import register
from cobaltmill.functions import webhooks as H
from cobaltmill.operators import payments as P
from cobaltmill.session import materialise, table

SECRET = "not-a-real-secret"

# One body text per order; the expression is plain SQL that both engines read the same way.
_AMOUNT = "CASE o_orderstatus WHEN 'F' THEN 40000 WHEN 'O' THEN 4000000 ELSE CAST(floor(o_totalprice) AS BIGINT) END"
BODY = f"""
CASE o_orderpriority
  WHEN '1-URGENT' THEN '{{"type":"Transaction.Succeeded","reference":"IF-' || o_custkey || '-' || (o_orderkey % 5) ||
       '","amount":' || {_AMOUNT} || ',"payer_email":" Ana' || o_custkey || '@Mail.com "}}'
  WHEN '2-HIGH' THEN '{{"event":"update","data":{{"status":"' || CASE o_orderstatus WHEN 'P' THEN 'pending' ELSE 'Captured' END ||
       '","transaction":{{"reference":" R' || o_custkey || '","amount_in_cents":' || {_AMOUNT} ||
       ',"customer_email":"c' || o_custkey || '@x.io"}},"metadata":{{"chat_id":"' || o_custkey || '"}}}}}}'
  WHEN '3-MEDIUM' THEN '{{"data":{{"payment":{{"status":"approved","id":"p' || o_custkey || '"}},"amount":' || {_AMOUNT} ||
       ',"description":"Plan Pro ?chat_id=' || o_custkey || '"}},"customer":{{"email":"a b@mail.com"}}}}'
  WHEN '4-NOT SPECIFIED' THEN '{{"status":"' || CASE o_orderstatus WHEN 'O' THEN 'paid' ELSE 'declined' END ||
       '","reference":" ' || o_custkey || ' ","amount_in_cents":null,"amount":' || {_AMOUNT} || ',"payer_email":"a@b"}}'
  ELSE CASE o_orderstatus WHEN 'P' THEN '{{"status": oops' WHEN 'O' THEN
       '{{"status":"SUCCESS","transaction":{{"metadata":{{"chat_id":' || o_custkey || '}},"amount":40000}},"payer":{{"email":"q' || o_custkey || '@mail.co"}}}}'
       ELSE '{{"status":"success","amount":40000,"checkout_url":"https://pay.example.com/x?y=1&chat_id=' || (o_custkey - 100) || '"}}' END
END
"""


def webhook_log(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("event_id"), F.col("o_orderdate").alias("ts"),
        (F.col("o_totalprice") > 20000).alias("signature_ok"), F.expr(BODY).alias("body"), *more)


def _first(paths) -> str:
    return "coalesce(" + ", ".join(
        f"nullif(trim(json_extract_string(j, '$.{p}')), '')" for p in paths) + ", '')"


def _amount_sql(paths=H.AMOUNT_PATHS) -> str:
    cases = " ".join(
        f"WHEN json_exists(j, '$.{p}') THEN coalesce(TRY_CAST(json_extract_string(j, '$.{p}') AS BIGINT), 0)" for p in paths)
    return f"CASE {cases} ELSE 0 END"


def _positive_sql(text: str) -> str:
    return f"(CASE WHEN TRY_CAST(trim({text}) AS BIGINT) > 0 THEN TRY_CAST(trim({text}) AS BIGINT) END)"


def _chat_sql() -> str:
    def raw(p):
        return f"json_extract_string(j, '$.{p}')"

    tries = [_positive_sql(raw(p)) for p in H.CHAT_ID_PATHS]
    tries += [_positive_sql(f"regexp_extract({raw(p)}, 'chat_id=([0-9]+)', 1)") for p in H.CHAT_TEXT_PATHS]
    for p in H.CHAT_REFERENCE_PATHS:
        tries += [_positive_sql(f"regexp_extract(trim({raw(p)}), '^IF-([0-9]+)-[0-9]+$', 1)"), _positive_sql(raw(p))]
    return "coalesce(" + ", ".join(tries) + ")"


_EVENT_SQL = f"""
WITH b AS (SELECT o_orderkey AS event_id, o_orderdate AS ts, o_totalprice > 20000 AS signature_ok, {BODY} AS body FROM orders),
j AS (SELECT *, CASE WHEN json_valid(body) THEN body END AS j FROM b),
t AS (SELECT event_id, ts, signature_ok, body, {_first(H.TYPE_PATHS)} AS type, {_first(H.STATUS_PATHS)} AS status,
             {_first(H.REFERENCE_PATHS)} AS reference, {_first(H.DESCRIPTION_PATHS)} AS description,
             {_amount_sql()} AS amount_raw, {_chat_sql()} AS chat_id, lower({_first(H.EMAIL_PATHS)}) AS mail FROM j),
e AS (SELECT * EXCLUDE (mail), CASE WHEN strpos(mail, '@') > 1 AND contains(substr(mail, strpos(mail, '@')), '.')
               AND NOT contains(mail, ' ') AND strlen(mail) <= 320 THEN mail ELSE '' END AS payer_email,
             lower(type) IN ('transaction.succeeded', 'transaction.approved')
             OR lower(status) IN ('succeeded', 'success', 'approved', 'paid', 'captured') AS is_success FROM t),
pesos AS (SELECT *, CASE WHEN amount_raw <= 0 THEN 0 WHEN amount_raw >= 1000000 AND amount_raw % 100 = 0
                         THEN amount_raw // 100 ELSE amount_raw END AS amount FROM e)
"""


def events(spark, sf, *fields: str) -> DataFrame:
    return P.normalise_events(webhook_log(spark, sf), fields=fields)


@register("webhook_normalize", _EVENT_SQL + "SELECT event_id, type, status, reference, description, amount_raw FROM e")
def webhook_normalize(spark, sf):
    fields = ("type", "status", "reference", "description", "amount_raw")
    return events(spark, sf, *fields).select("event_id", *fields)


@register("payer_email", _EVENT_SQL + "SELECT event_id, payer_email FROM e")
def payer_email(spark, sf):
    return events(spark, sf, "payer_email").select("event_id", "payer_email")


@register("payment_success", _EVENT_SQL + "SELECT event_id, is_success FROM e")
def payment_success(spark, sf):
    return events(spark, sf, "type", "status").select("event_id", "is_success")


@register("chat_id_extract", _EVENT_SQL + "SELECT event_id, chat_id FROM e")
def chat_id_extract(spark, sf):
    return events(spark, sf, "chat_id").select("event_id", "chat_id")


_RAW_AMOUNT = "CAST(floor(o_totalprice) AS BIGINT) * CASE o_orderstatus WHEN 'F' THEN 100 WHEN 'P' THEN -1 ELSE 1 END"


@register("amount_normalize", f"""
SELECT o_orderkey, CASE WHEN a <= 0 THEN 0 WHEN a >= 1000000 AND a % 100 = 0 THEN a // 100 ELSE a END AS pesos
FROM (SELECT o_orderkey, {_RAW_AMOUNT} AS a FROM orders)
""")
def amount_normalize(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", H.whole_pesos(F.expr(_RAW_AMOUNT)).alias("pesos"))


@register("amount_match", f"""
SELECT o_orderkey, (CASE WHEN a >= 1000000 AND a % 100 = 0 THEN a // 100 ELSE a END) = 40000 AS matches, a > 0 AS any_positive
FROM (SELECT o_orderkey, {_AMOUNT} AS a FROM orders)
""")
def amount_match(spark, sf):
    amount = F.expr(_AMOUNT).cast("bigint")
    return table(spark, sf, "orders").select(
        "o_orderkey", H.matches_price(amount, 40000).alias("matches"), H.matches_price(amount, 0).alias("any_positive"))


@register("checkout_hash", f"""
SELECT o_orderkey, sha256('IF-' || o_custkey || '-' || o_orderkey || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || 'COP{SECRET}') AS hash
FROM orders
""")
def checkout_hash(spark, sf):
    order = F.concat_ws("-", F.lit("IF"), F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string"))
    amount = F.floor("o_totalprice").cast("bigint")
    return table(spark, sf, "orders").select(
        "o_orderkey", H.checkout_hash(order, amount, F.lit("COP"), SECRET).alias("hash"))


def _pad_sql(mask: int) -> str:
    key = SECRET.encode().ljust(64, b"\0")
    return f"unhex('{bytes(b ^ mask for b in key).hex()}')"


_HMAC_SQL = f"sha256({_pad_sql(0x5C)} || unhex(sha256({_pad_sql(0x36)} || encode(body))))"


@register("signature_audit", f"""
WITH b AS (SELECT o_orderkey AS event_id, o_orderstatus, o_orderpriority, {BODY} AS body FROM orders),
m AS (SELECT event_id, o_orderstatus, o_orderpriority, {_HMAC_SQL} AS mac FROM b),
h AS (SELECT event_id, mac, CASE WHEN o_orderpriority = '5-LOW' THEN base64(unhex(mac))
        WHEN o_orderstatus = 'F' THEN ' ' || upper(mac) WHEN o_orderstatus = 'O' THEN 'sha256=' || mac
        WHEN o_orderpriority = '1-URGENT' THEN '' ELSE substr(mac, 3) || 'zz' END AS header FROM m)
SELECT event_id, mac, header <> '' AND (lower(replace(trim(header), 'sha256=', '')) = mac OR header = base64(unhex(mac))) AS signature_ok
FROM h
""")
def signature_audit(spark, sf):
    logged = webhook_log(spark, sf, "o_orderstatus", "o_orderpriority").drop("signature_ok").withColumn(
        "mac", H.hmac_sha256(F.col("body"), SECRET))
    header = (
        F.when(F.col("o_orderpriority") == "5-LOW", F.base64(F.unhex("mac")))
        .when(F.col("o_orderstatus") == "F", F.concat(F.lit(" "), F.upper("mac")))
        .when(F.col("o_orderstatus") == "O", F.concat(F.lit("sha256="), "mac"))
        .when(F.col("o_orderpriority") == "1-URGENT", "")
        .otherwise(F.concat(F.substring("mac", 3, 62), F.lit("zz")))
    )
    return logged.select(
        "event_id", "mac", H.signature_ok(F.col("body"), header, SECRET).alias("signature_ok"))


_PSP_BODY = """
'{"event":"' || CASE o_orderpriority WHEN '5-LOW' THEN 'other' ELSE 'transaction.updated' END ||
'","data":{"transaction":{"id":"t' || o_orderkey || '","status":"' || CASE o_orderstatus WHEN 'P' THEN '' WHEN 'O' THEN 'DECLINED' ELSE 'APPROVED' END ||
'","reference":"R' || o_custkey || '","amount_in_cents":' || CAST(floor(o_totalprice) AS BIGINT) || ',"customer_email":"c@x.io"}},"signature":{"properties":["transaction.id","data.transaction.status","transaction.amount_in_cents","transaction.missing"],"checksum":"' ||
CASE o_orderstatus WHEN 'O' THEN upper({sha}) ELSE 'abc' END || '"},"timestamp":' || o_custkey || '}'
"""
_PSP_SIGNED = (
    "'t' || o_orderkey || CASE o_orderstatus WHEN 'P' THEN '' WHEN 'O' THEN 'DECLINED' ELSE 'APPROVED' END || "
    f"CAST(floor(o_totalprice) AS BIGINT) || o_custkey || '{SECRET}'"
)


def _psp_log(spark, sf) -> DataFrame:
    body = _PSP_BODY.replace("{sha}", f"sha2({_PSP_SIGNED}, 256)")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("event_id"), F.expr(body).alias("body"))


_PSP_SQL = f"WITH b AS (SELECT o_orderkey AS event_id, {_PSP_BODY.replace('{sha}', f'sha256({_PSP_SIGNED})')} AS body FROM orders)"


@register("psp_map", _PSP_SQL + """
SELECT event_id, json_extract_string(body, '$.data.transaction.reference') AS reference,
       json_extract_string(body, '$.data.transaction.status') AS status,
       CAST(json_extract_string(body, '$.data.transaction.amount_in_cents') AS BIGINT) AS amount_raw,
       json_extract_string(body, '$.data.transaction.customer_email') AS customer_email
FROM b WHERE json_extract_string(body, '$.event') = 'transaction.updated'
  AND json_extract_string(body, '$.data.transaction.status') <> ''
""")
def psp_map(spark, sf):
    return P.psp_events(_psp_log(spark, sf)).drop("body")


@register("psp_checksum", _PSP_SQL + f"""
SELECT event_id, sha256(
         json_extract_string(body, '$.data.transaction.id') || json_extract_string(body, '$.data.transaction.status') ||
         json_extract_string(body, '$.data.transaction.amount_in_cents') || json_extract_string(body, '$.timestamp') || '{SECRET}') AS checksum,
       lower(json_extract_string(body, '$.signature.checksum')) = checksum AS checksum_ok
FROM b
""")
def psp_checksum(spark, sf):
    log = P.audit_checksums(_psp_log(spark, sf), F.lit(""), SECRET)
    return log.select("event_id", "checksum", "checksum_ok")


def payment_events(spark, sf) -> DataFrame:
    """Events with a reference, in the shape the fold reads."""
    read = events(spark, sf, "type", "status", "reference", "amount_raw", "chat_id", "payer_email")
    return read.filter(F.col("reference") != "").withColumn("amount", H.whole_pesos(F.col("amount_raw")))


_FOLD_SQL = """,
s AS (SELECT *, min((ts, event_id)) FILTER (WHERE pays) OVER (PARTITION BY reference) AS paid,
             min((ts, event_id)) OVER (PARTITION BY reference) AS opened FROM r)
SELECT reference, CASE WHEN bool_or(pays) THEN 'paid' ELSE 'failed' END AS status, min(ts) FILTER (WHERE pays) AS paid_at,
       max(amount) FILTER (WHERE (ts, event_id) = opened) AS amount,
       max(chat_id) FILTER (WHERE (ts, event_id) = paid) AS payer_chat_id,
       max(nullif(payer_email, '')) FILTER (WHERE (ts, event_id) = paid) AS payer_email,
       greatest(count(*) FILTER (WHERE pays) - 1, 0) AS already_processed, count(*) AS n_events
FROM s GROUP BY reference
"""
FOLD_ORACLE = _EVENT_SQL.rstrip() + ", r AS (SELECT *, is_success AS pays FROM pesos WHERE reference <> '')" + _FOLD_SQL


@register("payment_fold", FOLD_ORACLE)
def payment_fold(spark, sf):
    return P.payment_fold(payment_events(spark, sf))


STRICT_ORACLE = _EVENT_SQL.replace("WITH b", "WITH RECURSIVE b", 1).rstrip() + """,
o AS (SELECT *, row_number() OVER (PARTITION BY reference ORDER BY ts, event_id) AS i FROM pesos WHERE reference <> ''),
replay AS (
  SELECT reference, i, CASE WHEN is_success THEN 'paid' ELSE 'failed' END AS status, CASE WHEN is_success THEN ts END AS paid_at, amount,
         CASE WHEN is_success THEN chat_id END AS payer_chat_id, CASE WHEN is_success THEN nullif(payer_email, '') END AS payer_email,
         CAST(0 AS BIGINT) AS already_processed FROM o WHERE i = 1
  UNION ALL
  SELECT r.reference, o.i, CASE WHEN o.is_success THEN 'paid' ELSE 'failed' END,
         CASE WHEN o.is_success AND r.status <> 'paid' THEN o.ts ELSE r.paid_at END, r.amount,
         CASE WHEN o.is_success AND r.status <> 'paid' THEN coalesce(r.payer_chat_id, o.chat_id) ELSE r.payer_chat_id END,
         CASE WHEN o.is_success AND r.status <> 'paid' THEN coalesce(r.payer_email, nullif(o.payer_email, '')) ELSE r.payer_email END,
         r.already_processed + CASE WHEN o.is_success AND r.status = 'paid' THEN 1 ELSE 0 END
  FROM replay r JOIN o ON o.reference = r.reference AND o.i = r.i + 1)
SELECT reference, status, paid_at, amount, payer_chat_id, payer_email, already_processed, i AS n_events
FROM replay QUALIFY i = max(i) OVER (PARTITION BY reference)
"""


@register("payment_fold_strict", STRICT_ORACLE)
def payment_fold_strict(spark, sf):
    return P.payment_fold(payment_events(spark, sf), strict_reference=True)


@register("payment_outcome", _EVENT_SQL.rstrip() + """,
g AS (SELECT *, coalesce(nullif(reference, ''), 'bold-chat-' || chat_id) AS payment_reference,
        CASE WHEN NOT signature_ok THEN 'bad_signature' WHEN NOT is_success THEN 'unsuccessful'
             WHEN amount <> 40000 THEN 'wrong_amount' WHEN chat_id IS NULL THEN 'missing_chat_id' ELSE 'pays' END AS gate FROM pesos)
SELECT event_id, payment_reference, CASE WHEN gate <> 'pays' THEN gate
         WHEN row_number() OVER (PARTITION BY payment_reference, gate ORDER BY ts, event_id) = 1 THEN 'activated'
         ELSE 'duplicate' END AS outcome
FROM g
""")
def payment_outcome(spark, sf):
    # Stored once: the outcome reads the events twice and must not parse the bodies again.
    read = events(spark, sf, "type", "status", "reference", "amount_raw", "chat_id")
    stored = materialise(read.drop("body"), "payment-events")
    return P.payment_outcome(stored).select("event_id", "payment_reference", "outcome")
