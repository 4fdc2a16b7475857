"""Streaming forms, run over the stored tables as streams until all available rows are done."""

from __future__ import annotations

from pyspark.sql import functions as F

from cobaltmill.catalog import events as E
from cobaltmill.catalog import payments as Y
from cobaltmill.catalog.registry import register
from cobaltmill.operators import payments as P
from cobaltmill.functions import webhooks as H
from cobaltmill.session import fresh_path
from cobaltmill.streaming import jobs
from cobaltmill.streaming.sources import table_stream


@register("daily_quota_stream", E._QUOTA_SQL + "SELECT event_id, user_id, local_day, outcome FROM q")
def daily_quota_stream(spark, sf):
    stream = table_stream(spark, sf, "events").filter(F.col("event_type") != "purchase")
    outcomes = jobs.daily_quota_stream(
        stream.select("event_id", "user_id", "ts"), E.since(spark, sf), fresh_path(spark, "quota"), E.LIMIT)
    return outcomes.select("event_id", "user_id", "local_day", "outcome")


@register("payment_fold_stream", Y.FOLD_ORACLE)
def payment_fold_stream(spark, sf):
    log = table_stream(spark, sf, "orders").select(
        F.col("o_orderkey").alias("event_id"), F.col("o_orderdate").alias("ts"), F.expr(Y.BODY).alias("body"))
    fields = ("type", "status", "reference", "amount_raw", "chat_id", "payer_email")
    events = P.normalise_events(log, fields=fields).filter(F.col("reference") != "")
    events = events.withColumn("amount", H.whole_pesos(F.col("amount_raw")))
    return jobs.payment_fold_stream(events, fresh_path(spark, "payments"))


@register("payment_fold_strict_stream", Y.STRICT_ORACLE)
def payment_fold_strict_stream(spark, sf):
    log = table_stream(spark, sf, "orders").select(
        F.col("o_orderkey").alias("event_id"), F.col("o_orderdate").alias("ts"), F.expr(Y.BODY).alias("body"))
    fields = ("type", "status", "reference", "amount_raw", "chat_id", "payer_email")
    events = P.normalise_events(log, fields=fields).filter(F.col("reference") != "")
    events = events.withColumn("amount", H.whole_pesos(F.col("amount_raw")))
    return jobs.strict_payment_stream(events, fresh_path(spark, "strict-payments"))


@register("session_stream", E.SESSION_SQL + """,
w AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR AS mark FROM m)
SELECT * FROM found WHERE session_end + INTERVAL 6 HOURS <= (SELECT mark FROM w)
""")
def session_stream(spark, sf):
    sent = table_stream(spark, sf, "events").filter(F.col("event_type") != "purchase").select("user_id", "ts")
    return jobs.session_stream(sent, fresh_path(spark, "sessions"), E.SESSION_GAP)


@register("token_first_use_stream", E._TOKEN_SQL + "SELECT f.use_id, f.token, u.used_at FROM f JOIN u ON u.use_id = f.use_id WHERE is_first")
def token_first_use_stream(spark, sf):
    from cobaltmill.session import table

    uses = E.uses(table_stream(spark, sf, "events"))
    uses = uses.withColumn("used_at", F.col("used_at").cast("timestamp"))
    issued = E.issues(table(spark, sf, "events"))
    firsts = jobs.first_use_stream(uses, issued, fresh_path(spark, "first-use"))
    return firsts.withColumn("used_at", F.col("used_at").cast("timestamp_ntz"))


@register("token_expiry_stream", E._TOKEN_SQL.rstrip() + """,
w AS (SELECT date_trunc('milliseconds', least((SELECT max(issued_at) FROM i), (SELECT max(used_at) FROM u))) - INTERVAL 1 MINUTE AS mark)
SELECT token, use_id FROM r WHERE is_live
UNION ALL SELECT token, NULL FROM x WHERE token NOT IN (SELECT token FROM r WHERE is_live)
  AND issued_at <= (SELECT mark FROM w) - INTERVAL 30 MINUTES
""")
def token_expiry_stream(spark, sf):
    events = table_stream(spark, sf, "events")
    issued = E.issues(events).withColumn("issued_at", F.col("issued_at").cast("timestamp"))
    used = E.uses(table_stream(spark, sf, "events")).withColumn("used_at", F.col("used_at").cast("timestamp"))
    return jobs.token_expiry_stream(issued, used, fresh_path(spark, "expiry")).select("token", "use_id")
