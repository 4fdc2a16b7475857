"""Quota, plan, identity and token queries over the event log."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cobaltmill.catalog.registry import register
from cobaltmill.functions import clock
from cobaltmill.operators import identities, tokens, usage
from cobaltmill.operators.sessions import sessions
from cobaltmill.session import fresh_path, table
from cobaltmill.sources.sinks import write_records

LIMIT = 3  # below the busiest day of the test tables
ASOF = "2024-01-15 12:00:00"


def _asof():
    return F.lit(ASOF).cast("timestamp_ntz")


def messages(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").filter(F.col("event_type") != "purchase")
    return events.select("event_id", "user_id", "ts")


def payments(spark: SparkSession, sf: str) -> DataFrame:
    paid = (F.col("event_type") == "purchase") & (F.col("value") > 150)
    return table(spark, sf, "events").filter(paid).select("user_id", "ts")


def since(spark, sf) -> DataFrame:
    return usage.premium_since(payments(spark, sf))


_PAID = "p AS (SELECT user_id, min(ts) AS since FROM events WHERE event_type = 'purchase' AND value > 150 GROUP BY user_id)"
_QUOTA_SQL = f"""
WITH {_PAID},
m AS (SELECT event_id, user_id, ts, CAST(ts - INTERVAL 5 HOURS AS DATE) AS local_day, since,
             coalesce(ts >= since, false) AS prem
      FROM events LEFT JOIN p USING (user_id) WHERE event_type <> 'purchase'),
q AS (SELECT *, CASE WHEN prem THEN 'premium'
                     WHEN row_number() OVER (PARTITION BY user_id, local_day, prem ORDER BY ts, event_id) <= {LIMIT}
                     THEN 'admitted' ELSE 'refused' END AS outcome FROM m)
"""


@register("daily_quota", _QUOTA_SQL + "SELECT event_id, user_id, local_day, outcome FROM q")
def daily_quota(spark, sf):
    return usage.daily_quota(messages(spark, sf), since(spark, sf), LIMIT).drop("ts")


_STATE_SQL = f"""
WITH {_PAID.replace("GROUP BY", f"AND ts <= TIMESTAMP '{ASOF}' GROUP BY")},
d AS (SELECT user_id, CAST(ts - INTERVAL 5 HOURS AS DATE) AS day,
             least(count_if(NOT coalesce(ts >= since, false)), {LIMIT}) AS counted
      FROM events LEFT JOIN p USING (user_id)
      WHERE event_type <> 'purchase' AND ts <= TIMESTAMP '{ASOF}' GROUP BY ALL),
s AS (SELECT user_id, CAST(coalesce(sum(counted) FILTER (WHERE day = DATE '{ASOF[:10]}'), 0) AS BIGINT) AS messages_today,
             CAST(sum(counted) AS BIGINT) AS lifetime_messages FROM d GROUP BY user_id),
st AS (SELECT s.*, since IS NOT NULL AS is_premium,
         CASE WHEN since IS NOT NULL THEN -1 ELSE greatest({LIMIT} - messages_today, 0) END AS credits_remaining,
         since IS NULL AND messages_today >= {LIMIT} AS paywall, since AS premium_since
  FROM s LEFT JOIN p USING (user_id))
"""


@register("quota_state", _STATE_SQL + "SELECT * FROM st")
def quota_state(spark, sf):
    return usage.quota_state(messages(spark, sf), since(spark, sf), _asof(), LIMIT)


@register("billing_status", _STATE_SQL + f"""
SELECT user_id, is_premium, CASE WHEN is_premium THEN 'premium' ELSE 'free' END AS plan, messages_today,
       CAST({LIMIT} AS BIGINT) AS daily_limit, credits_remaining, NOT is_premium AS show_upgrade_button,
       is_premium AS show_pdf_button, paywall AS paywall_active, premium_since,
       TIMESTAMP '2024-01-16 05:00:00' AS quota_resets_at FROM st
""")
def billing_status(spark, sf):
    return usage.billing_status(quota_state(spark, sf), _asof(), LIMIT)


@register("next_reset", """
SELECT event_id, date_trunc('day', ts - INTERVAL 5 HOURS) + INTERVAL 1 DAY + INTERVAL 5 HOURS AS resets_at FROM events
""")
def next_reset(spark, sf):
    return table(spark, sf, "events").select("event_id", clock.next_reset(F.col("ts")).alias("resets_at"))


@register("same_local_day", """
SELECT event_id, CAST(ts - INTERVAL 5 HOURS AS DATE) = CAST(ts + INTERVAL 90 MINUTES - INTERVAL 5 HOURS AS DATE) AS same_day
FROM events
""")
def same_local_day(spark, sf):
    later = F.col("ts") + F.expr("INTERVAL 90 MINUTES")
    return table(spark, sf, "events").select(
        "event_id", clock.same_local_day(F.col("ts"), later).alias("same_day"))


@register("conversation_append", _QUOTA_SQL + """
SELECT user_id AS chat_id, 'user' AS role, count(*) AS n_messages, max(ts) AS last_at
FROM q WHERE outcome <> 'refused' GROUP BY user_id
""")
def conversation_append(spark, sf):
    outcomes = usage.daily_quota(messages(spark, sf), since(spark, sf), LIMIT)
    rows = outcomes.filter(F.col("outcome") != "refused").select(
        F.col("user_id").alias("chat_id"), F.lit("user").alias("role"),
        F.col("event_id").cast("string").alias("content"), F.col("ts").alias("created_at"))
    stored = write_records(rows, fresh_path(spark, "conversations"), "parquet")
    return stored.groupBy("chat_id", "role").agg(
        F.count("content").alias("n_messages"), F.max("created_at").alias("last_at"))


@register("premium_since", f"WITH {_PAID} SELECT user_id, since AS premium_since FROM p")
def premium_since(spark, sf):
    return since(spark, sf)


@register("premium_after_revoke", """
WITH r AS (SELECT user_id, max(ts) AS revoked FROM events WHERE event_type = 'error' AND value > 120 GROUP BY user_id)
SELECT user_id, min(ts) AS premium_since FROM events LEFT JOIN r USING (user_id)
WHERE event_type = 'purchase' AND value > 150 AND (revoked IS NULL OR ts > revoked) GROUP BY user_id
""")
def premium_after_revoke(spark, sf):
    revoked = (F.col("event_type") == "error") & (F.col("value") > 120)
    revokes = table(spark, sf, "events").filter(revoked).select("user_id", "ts")
    return usage.premium_since(payments(spark, sf), revokes)


@register("premium_asof", f"""
WITH {_PAID} SELECT event_id, user_id, coalesce(ts >= since, false) AS is_premium FROM events LEFT JOIN p USING (user_id)
""")
def premium_asof(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "ts")
    return usage.with_premium(events, since(spark, sf)).drop("ts")


@register("premium_periods", """
WITH c AS (
  SELECT user_id, ts, event_id, event_type = 'purchase' AS active FROM events
  WHERE (event_type = 'purchase' AND value > 60) OR (event_type = 'error' AND value > 40)),
l AS (SELECT user_id, ts, arg_max(active, event_id) AS active FROM c GROUP BY ALL)
SELECT e.event_id, e.user_id, coalesce(l.active, false) AS is_premium, l.ts AS since
FROM events e ASOF LEFT JOIN l ON e.user_id = l.user_id AND e.ts >= l.ts
""")
def premium_periods(spark, sf):
    """Premium by several grants and revokes of each user: the last one at or before an event holds."""
    events = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type", "value")
    grant = (F.col("event_type") == "purchase") & (F.col("value") > 60)
    revoke = (F.col("event_type") == "error") & (F.col("value") > 40)
    changes = events.filter(grant | revoke).select(
        "user_id", "ts", F.col("event_id").alias("change_id"), (F.col("event_type") == "purchase").alias("active"))
    return usage.premium_by_periods(events.select("event_id", "user_id", "ts"), changes).drop("ts")


_GATE_SQL = f"""
WITH {_PAID},
g AS (SELECT event_id, user_id, CASE event_type WHEN 'view' THEN 'PDF' WHEN 'click' THEN 'excel' ELSE 'chart' END AS resource_type,
             coalesce(ts >= since, false) AS prem FROM events LEFT JOIN p USING (user_id)),
s AS (SELECT *, CAST(CASE WHEN resource_type <> 'chart' AND NOT prem THEN 403 ELSE 200 END AS BIGINT) AS http_status FROM g)
"""


def _gate(spark, sf):
    resource = F.when(F.col("event_type") == "view", "PDF").when(F.col("event_type") == "click", "excel").otherwise("chart")
    requests = table(spark, sf, "events").select("event_id", "user_id", "ts", resource.alias("resource_type"))
    return usage.entitlement_gate(requests, since(spark, sf)).drop("ts", "is_premium")


@register("entitlement_gate", _GATE_SQL + "SELECT event_id, user_id, resource_type, http_status FROM s")
def entitlement_gate(spark, sf):
    return _gate(spark, sf)


@register("entitlement_denied", _GATE_SQL + """
SELECT resource_type, count(*) AS n_denied, count(DISTINCT user_id) AS n_users FROM s WHERE http_status = 403 GROUP BY resource_type
""")
def entitlement_denied(spark, sf):
    denied = _gate(spark, sf).filter(F.col("http_status") == 403)
    return denied.groupBy("resource_type").agg(
        F.count(F.lit(1)).alias("n_denied"), F.count_distinct("user_id").alias("n_users"))


# --- identities ---------------------------------------------------------------------------------

# Chats and e-mails of an order stay within the family of its customer, so every family is replayed
# request by request on its own.
_IDENTITY_SQL = """
WITH RECURSIVE users AS (
  SELECT c_custkey AS user_id, CASE WHEN c_acctbal >= 0 THEN c_custkey END AS chat_id,
         CASE WHEN c_mktsegment <> 'BUILDING' THEN lower(c_name) || '@mail.com' END AS email FROM customer),
requests AS (
  SELECT o_orderkey AS request_id,
         CASE o_orderpriority WHEN '5-LOW' THEN o_custkey + 1000000 WHEN '1-URGENT' THEN NULL ELSE o_custkey END AS chat_id,
         CASE o_orderstatus WHEN 'O' THEN NULL WHEN 'F' THEN 'customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') || '@mail.com'
              ELSE 'new' || (o_custkey % 500) || '@mail.com' END AS email, o_custkey % 500 AS f FROM orders),
asked AS (
  SELECT request_id, chat_id, email, f, row_number() OVER (PARTITION BY f ORDER BY request_id) AS i
  FROM requests),
start AS (
  SELECT f, coalesce(list({'k': CAST(user_id AS VARCHAR), 'c': CAST(chat_id AS BIGINT), 'e': email})
                     FILTER (WHERE user_id IS NOT NULL), []) AS us
  FROM (SELECT DISTINCT f FROM asked UNION SELECT DISTINCT user_id % 500 FROM users) LEFT JOIN users ON user_id % 500 = f GROUP BY f),
replay AS (
  SELECT f, CAST(0 AS BIGINT) AS i, us, CAST(NULL AS BIGINT) AS request_id, CAST(NULL AS BIGINT) AS chat_id,
         CAST(NULL AS VARCHAR) AS email, '' AS resolution, CAST(NULL AS VARCHAR) AS user_key FROM start
  UNION ALL
  SELECT f, i,
    CASE WHEN cu IS NOT NULL AND email IS NOT NULL AND cu.e IS NULL AND eu IS NULL
         THEN list_transform(us, lambda u: CASE WHEN u.k = cu.k THEN {'k': u.k, 'c': u.c, 'e': email} ELSE u END)
         WHEN cu IS NULL AND eu IS NOT NULL AND chat_id IS NOT NULL AND eu.c IS NULL
         THEN list_transform(us, lambda u: CASE WHEN u.k = eu.k THEN {'k': u.k, 'c': chat_id, 'e': u.e} ELSE u END)
         WHEN cu IS NULL AND eu IS NULL AND made IS NOT NULL
         THEN list_append(us, {'k': made, 'c': chat_id, 'e': email}) ELSE us END,
    request_id, chat_id, email,
    CASE WHEN cu IS NOT NULL THEN 'chat' WHEN eu IS NOT NULL THEN 'email' WHEN made IS NOT NULL THEN 'created' ELSE 'rejected' END,
    coalesce(cu.k, eu.k, made)
  FROM (SELECT r.f, a.i, r.us, a.request_id, CAST(a.chat_id AS BIGINT) AS chat_id, a.email,
               coalesce('chat:' || a.chat_id, 'mail:' || a.email) AS made,
               list_filter(r.us, lambda u: u.c = a.chat_id)[1] AS cu, list_filter(r.us, lambda u: u.e = a.email)[1] AS eu
        FROM replay r JOIN asked a ON a.f = r.f AND a.i = r.i + 1))
"""


def _identity(spark, sf):
    customers, orders = table(spark, sf, "customer"), table(spark, sf, "orders")
    users = customers.select(
        F.col("c_custkey").alias("user_id"), F.when(F.col("c_acctbal") >= 0, F.col("c_custkey")).alias("chat_id"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.concat("c_name", F.lit("@mail.com"))).alias("email"))
    key = F.col("o_custkey").cast("string")
    chat = F.when(F.col("o_orderpriority") == "5-LOW", F.col("o_custkey") + 1000000).when(
        F.col("o_orderpriority") != "1-URGENT", F.col("o_custkey"))
    email = (
        F.when(F.col("o_orderstatus") == "O", " ")
        .when(F.col("o_orderstatus") == "F", F.concat(F.lit(" Customer#"), F.lpad(key, 9, "0"), F.lit("@Mail.com")))
        .otherwise(F.concat(F.lit("new"), (F.col("o_custkey") % 500).cast("string"), F.lit("@mail.com")))
    )
    requests = orders.select(F.col("o_orderkey").alias("request_id"), chat.alias("chat_id"), email.alias("email"))
    return identities.get_or_create(users, requests)


@register("get_or_create", _IDENTITY_SQL + "SELECT request_id, chat_id, email, resolution, user_key FROM replay WHERE i > 0")
def get_or_create(spark, sf):
    return _identity(spark, sf)[0]


@register("get_or_create_users", _IDENTITY_SQL + """
SELECT u.k AS user_key, u.c AS chat_id, u.e AS email
FROM (SELECT unnest(arg_max(us, i)) AS u FROM replay GROUP BY f)
""")
def get_or_create_users(spark, sf):
    return _identity(spark, sf)[1]


@register("identity_link", """
WITH l AS (SELECT user_id AS chat_id, 'u' || json_extract_string(props, '$.k') || '@mail.com' AS email, ts, event_id
           FROM events WHERE event_type = 'signup'),
r AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY ts DESC, event_id DESC) AS rc,
             row_number() OVER (PARTITION BY email ORDER BY ts DESC, event_id DESC) AS re FROM l)
SELECT chat_id, email, ts AS linked_at FROM r WHERE rc = 1 AND re = 1
""")
def identity_link(spark, sf):
    email = F.concat(F.lit(" U"), F.get_json_object("props", "$.k"), F.lit("@mail.com"))
    links = table(spark, sf, "events").filter(F.col("event_type") == "signup").select(
        F.col("user_id").alias("chat_id"), email.alias("email"), "ts", "event_id")
    return usage.identity_links(links)


# --- tokens -------------------------------------------------------------------------------------

def issues(events: DataFrame) -> DataFrame:
    """Every view issues one token; the resource depends on the payload."""
    k = F.get_json_object("props", "$.k").cast("int")
    resource = F.when(k < 40, "dashboard").when(k < 60, "chart").when(k < 80, "pdf").otherwise("excel")
    return events.filter(F.col("event_type") == "view").select(
        F.col("event_id").alias("token"), F.col("ts").alias("issued_at"), F.col("user_id").alias("chat_id"),
        resource.alias("resource_type"),
        F.when(F.col("value") < 8, " ").otherwise(F.col("props")).alias("payload"))


def uses(events: DataFrame) -> DataFrame:
    """Every click uses the token issued a few events earlier, if there was one."""
    back = F.get_json_object("props", "$.k").cast("long") % 7 + 1
    return events.filter(F.col("event_type") == "click").select(
        F.col("event_id").alias("use_id"), (F.col("event_id") - back).alias("token"), F.col("ts").alias("used_at"))


_TOKEN_SQL = """
WITH i AS (SELECT event_id AS token, ts AS issued_at, user_id AS chat_id,
        CASE WHEN k < 40 THEN 'dashboard' WHEN k < 60 THEN 'chart' WHEN k < 80 THEN 'pdf' ELSE 'excel' END AS resource_type,
        CASE WHEN value < 8 THEN ' ' ELSE props END AS payload
      FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) WHERE event_type = 'view'),
x AS (SELECT *, issued_at + CASE resource_type WHEN 'dashboard' THEN INTERVAL 15 MINUTES ELSE INTERVAL 30 MINUTES END AS expires_at FROM i),
u AS (SELECT event_id AS use_id, event_id - CAST(json_extract_string(props, '$.k') AS BIGINT) % 7 - 1 AS token, ts AS used_at
      FROM events WHERE event_type = 'click'),
r AS (SELECT u.*, x.* EXCLUDE (token), coalesce(used_at BETWEEN issued_at AND expires_at, false) AS is_live
      FROM u LEFT JOIN x ON u.token = x.token),
f AS (SELECT use_id, token, row_number() OVER (PARTITION BY token ORDER BY used_at, use_id) = 1 AS is_first, resource_type
      FROM r WHERE is_live)
"""


def _token_tables(spark, sf):
    events = table(spark, sf, "events")
    return uses(events), issues(events)


@register("token_ttl", _TOKEN_SQL + "SELECT use_id, token, resource_type, expires_at, is_live FROM r")
def token_ttl(spark, sf):
    resolved = tokens.resolve_uses(*_token_tables(spark, sf))
    return resolved.select("use_id", "token", "resource_type", "expires_at", "is_live")


@register("token_first_use", _TOKEN_SQL + """
SELECT use_id, token, is_first, is_first OR resource_type <> 'dashboard' AS accepted FROM f
""")
def token_first_use(spark, sf):
    return tokens.first_uses(*_token_tables(spark, sf)).select("use_id", "token", "is_first", "accepted")


_CHATS_SQL = """
c AS (SELECT user_id AS chat_id, bool_or(event_type = 'view' AND value > 120) AS has_snapshot,
             bool_or(event_type = 'error' AND value > 60) AS has_files FROM events GROUP BY user_id)
"""


def _chats(spark, sf) -> DataFrame:
    """Does a chat have a saved dashboard, and does it have files?"""
    kind, value = F.col("event_type"), F.col("value")
    return table(spark, sf, "events").groupBy(F.col("user_id").alias("chat_id")).agg(
        F.bool_or((kind == "view") & (value > 120)).alias("has_snapshot"),
        F.bool_or((kind == "error") & (value > 60)).alias("has_files"))


@register("token_outcome", _TOKEN_SQL.rstrip() + f""",
{_CHATS_SQL},
v AS (SELECT u.*, x.chat_id, x.payload, coalesce(used_at BETWEEN issued_at AND expires_at, false) AS is_live
      FROM u LEFT JOIN x ON u.token = x.token AND x.resource_type = 'dashboard'),
o AS (SELECT v.*, is_live AND trim(payload) <> '' AS servable FROM v),
g AS (SELECT o.*, servable AND row_number() OVER (PARTITION BY token, servable ORDER BY used_at, use_id) = 1 AS served FROM o)
SELECT use_id, g.token, used_at, CAST(CASE WHEN served THEN 200 WHEN is_live AND has_snapshot THEN 409
       WHEN is_live AND has_files THEN 202 ELSE 404 END AS BIGINT) AS http_status
FROM g LEFT JOIN c ON g.chat_id = c.chat_id
""")
def token_outcome(spark, sf):
    return tokens.token_outcome(*_token_tables(spark, sf), _chats(spark, sf))


@register("dashboard_refresh", f"""
WITH {_CHATS_SQL.strip()}
SELECT event_id, user_id - 1 AS chat_id, CAST(CASE WHEN user_id - 1 <= 0 THEN 422 WHEN has_snapshot THEN 200
       WHEN has_files THEN 202 ELSE 404 END AS BIGINT) AS http_status
FROM events LEFT JOIN c ON c.chat_id = user_id - 1 WHERE event_type = 'click'
""")
def dashboard_refresh(spark, sf):
    requests = table(spark, sf, "events").filter(F.col("event_type") == "click").select(
        "event_id", (F.col("user_id") - 1).alias("chat_id"))
    return tokens.refresh_outcome(requests, _chats(spark, sf))


@register("token_expire_gc", _TOKEN_SQL + """
SELECT token, resource_type, expires_at FROM x WHERE expires_at >= issued_at + INTERVAL 1 MINUTE * (chat_id % 40)
""")
def token_expire_gc(spark, sf):
    # Every chat is cleaned up at its own time after the issue.
    _, issued = _token_tables(spark, sf)
    asof = F.col("issued_at") + F.make_dt_interval(mins=(F.col("chat_id") % 40).cast("int"))
    return tokens.live_tokens(issued, asof).select("token", "resource_type", "expires_at")


@register("latest_snapshot", """
SELECT user_id, props AS payload, ts AS saved_at FROM events WHERE event_type = 'view'
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1
""")
def latest_snapshot(spark, sf):
    return usage.latest_snapshot(table(spark, sf, "events").filter(F.col("event_type") == "view"), "props")


# --- configuration and uploads ------------------------------------------------------------------

@register("tier_config", """
WITH u AS (SELECT *, c_acctbal > 3000 AS prem, CASE c_mktsegment WHEN 'BUILDING' THEN ['Pie ', 'bars', 'pie', 'radar']
             WHEN 'MACHINERY' THEN ['radar'] WHEN 'HOUSEHOLD' THEN ['TREEMAP', 'heatmap'] END AS wanted FROM customer),
a AS (SELECT *, list_filter([lower(trim(w)) FOR w IN wanted], lambda w: list_contains(['bars', 'heatmap', 'pie', 'treemap'], w)) AS ok FROM u)
SELECT c_custkey AS user_id, CASE WHEN prem THEN 'premium' ELSE 'free' END AS tier,
       CASE WHEN NOT prem OR coalesce(len(ok), 0) = 0 THEN 'bars,heatmap,pie,treemap'
            WHEN c_mktsegment = 'BUILDING' THEN 'pie,bars' ELSE array_to_string(ok, ',') END AS chart_types,
       CASE WHEN NOT prem THEN '#808080' WHEN c_nationkey % 3 = 0 THEN '#0' || c_nationkey
            WHEN c_nationkey % 3 = 1 THEN '#abc' ELSE '#28468C' END AS primary_color,
       CASE WHEN prem AND c_nationkey % 2 = 0 THEN '#fff' ELSE '#ff6d00' END AS secondary_color,
       CASE WHEN prem THEN CASE WHEN c_nationkey < 6 THEN 11 ELSE CAST(c_nationkey AS BIGINT) END
            ELSE 11 END AS font_size_body,
       CASE WHEN prem AND c_nationkey >= 8 THEN CAST(c_nationkey AS BIGINT) WHEN prem THEN 16 ELSE 20 END AS font_size_titles
FROM a
""")
def tier_config(spark, sf):
    nation, segment = F.col("c_nationkey"), F.col("c_mktsegment")
    charts = (
        F.when(segment == "BUILDING", '["Pie ", "bars", "pie", "radar"]').when(segment == "MACHINERY", '["radar"]')
        .when(segment == "HOUSEHOLD", '["TREEMAP", "heatmap"]').when(segment == "AUTOMOBILE", "not json")
    )
    users = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("user_id"), (F.col("c_acctbal") > 3000).alias("is_premium"), charts.alias("branding_charts"),
        F.when(nation % 3 == 0, F.concat(F.lit("#0"), nation.cast("string"))).when(nation % 3 == 1, " ").alias("branding_color"),
        F.when(nation % 2 == 0, "#fff").alias("branding_color_sec"), nation.alias("branding_font_body"),
        nation.alias("branding_font_title"), F.when(nation % 3 == 1, "#abc").otherwise("").alias("primary_color"),
        F.lit("#ff6d00").alias("secondary_color"), F.lit(0).alias("font_size_body"), F.lit(20).alias("font_size_titles"))
    return usage.tier_config(users)


@register("upload_audit", """
SELECT user_id, 'f' || event_id || '.' || CASE event_type WHEN 'purchase' THEN 'CSV' WHEN 'view' THEN 'pdf' ELSE 'txt' END AS filename,
       CASE event_type WHEN 'purchase' THEN 'data' WHEN 'view' THEN 'pdf' ELSE 'document' END AS file_type,
       'data/' || user_id || '/' || filename AS file_path, CAST(floor(value * 1024) AS BIGINT) AS size_bytes, true AS indexed,
       CAST(json_extract_string(props, '$.k') AS BIGINT) AS indexed_chunks
FROM events WHERE value >= 20 AND event_type <> 'error'
""")
def upload_audit(spark, sf):
    kind = F.col("event_type")
    ext = F.when(kind == "purchase", "CSV").when(kind == "view", "pdf").otherwise("txt")
    path = F.concat(
        F.lit("data/"), F.col("user_id").cast("string"), F.lit("/f"), F.col("event_id").cast("string"), F.lit("."), ext)
    uploads = table(spark, sf, "events").select(
        "user_id", path.alias("path"), (F.col("value") >= 20).alias("indexed"),
        F.when(kind == "error", "failed").alias("error"), F.floor(F.col("value") * 1024).alias("size_bytes"),
        F.get_json_object("props", "$.k").cast("long").alias("indexed_chunks"))
    return usage.upload_audit(uploads)


@register("udf_surface", """
SELECT o_orderkey, o_orderpriority AS priority, o_totalprice AS price,
       CASE WHEN w >= 1000000 AND w % 100 = 0 THEN w // 100 ELSE w END AS pesos,
       CAST(o_orderdate - INTERVAL 5 HOURS AS DATE) AS day, CAST(floor(o_totalprice) AS DOUBLE) AS cop,
       lpad(CAST(o_custkey AS VARCHAR), 9, '9') AS id
FROM (SELECT *, CAST(floor(o_totalprice) * 10 AS BIGINT) AS w FROM orders)
""")
def udf_surface(spark, sf):
    from cobaltmill.plans.surface import register_sql_functions

    register_sql_functions(spark)
    table(spark, sf, "orders").createOrReplaceTempView("cobaltmill_orders")
    return spark.sql("""
        SELECT o_orderkey, norm_text(concat('  ', o_orderpriority, ' ')) AS priority,
               parse_usd(concat('US$ ', format_number(o_totalprice, 2))) AS price,
               whole_pesos(floor(o_totalprice) * 10) AS pesos, local_day(o_orderdate) AS day,
               parse_cop(concat('$', translate(format_number(floor(o_totalprice), 0), ',', '.'), ',00')) AS cop,
               id_normalize(concat(lpad(CAST(o_custkey AS STRING), 9, '9'), '-', o_orderstatus)) AS id
        FROM cobaltmill_orders
    """)


SESSION_GAP = dt.timedelta(hours=6)
#: Gaps and islands.
SESSION_SQL = """
WITH m AS (SELECT user_id, ts FROM events WHERE event_type <> 'purchase'),
opened AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOURS
                          THEN 0 ELSE 1 END AS opens FROM m),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS number FROM opened),
found AS (SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS n_messages
          FROM numbered GROUP BY user_id, number)
"""


@register("message_sessions", SESSION_SQL + "SELECT * FROM found")
def message_sessions(spark, sf):
    return sessions(messages(spark, sf), SESSION_GAP)
