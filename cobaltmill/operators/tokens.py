"""Download tokens: issue and use logs, one-shot rules, expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cobaltmill.functions import vocab
from cobaltmill.session import materialise


def ttl_minutes(resource: Column) -> Column:
    short = F.lower(resource) == "dashboard"
    return F.when(short, vocab.DASHBOARD_TOKEN_MINUTES).otherwise(vocab.TOKEN_MINUTES)


def with_expiry(issues: DataFrame) -> DataFrame:
    """Adds ``expires_at`` to issues (token, issued_at, resource_type, ...)."""
    life = F.make_dt_interval(mins=ttl_minutes(F.col("resource_type")))
    return issues.withColumn("expires_at", F.col("issued_at") + life)


def resolve_uses(uses: DataFrame, issues: DataFrame) -> DataFrame:
    """Each use (use_id, token, used_at) with its token and whether the token was still valid.

    A token is issued once, so the join never multiplies rows; uses of unknown tokens are kept.
    """
    joined = uses.join(with_expiry(issues), "token", "left")
    live = (F.col("used_at") >= F.col("issued_at")) & (F.col("used_at") <= F.col("expires_at"))
    return joined.withColumn("is_live", F.coalesce(live, F.lit(False)))


def first_uses(uses: DataFrame, issues: DataFrame) -> DataFrame:
    """Live uses with ``is_first`` and ``accepted``: a dashboard link works once, others again."""
    live = resolve_uses(uses, issues).filter("is_live")
    firsts = live.groupBy("token").agg(F.min(F.struct("used_at", "use_id")).alias("__first"))
    is_first = F.struct("used_at", "use_id") == F.col("__first")
    one_shot = F.lower("resource_type") == "dashboard"
    return (
        live.join(materialise(firsts, "first-uses"), "token")
        .withColumn("is_first", is_first)
        .withColumn("accepted", F.col("is_first") | ~one_shot)
        .drop("__first")
    )


def token_outcome(uses: DataFrame, issues: DataFrame, chats: DataFrame) -> DataFrame:
    """HTTP outcome of each dashboard visit: 200, 409 used, 202 pending or 404.

    ``issues`` carries chat_id and payload; ``chats`` is (chat_id, has_snapshot, has_files).
    """
    sessions = issues.filter(F.lower("resource_type") == "dashboard")
    visits = resolve_uses(uses, sessions)
    payload = F.coalesce(F.trim("payload"), F.lit("")) != ""
    servable = F.col("is_live") & payload
    firsts = visits.filter(servable).groupBy("token").agg(
        F.min(F.struct("used_at", "use_id")).alias("__first")
    )
    firsts = materialise(firsts, "first-visits")
    chats = materialise(chats, "chats")
    joined = visits.join(firsts, "token", "left").join(chats, "chat_id", "left")
    first = F.struct("used_at", "use_id") == F.col("__first")
    status = (
        F.when(servable & first, 200)
        .when(F.col("is_live") & F.coalesce("has_snapshot", F.lit(False)), 409)
        .when(F.col("is_live") & F.coalesce("has_files", F.lit(False)), 202)
        .otherwise(404)
    )
    return joined.select(*uses.columns, status.cast("long").alias("http_status"))


def refresh_outcome(requests: DataFrame, chats: DataFrame) -> DataFrame:
    """HTTP outcome of asking for a new dashboard link: 200 from the last snapshot, 202 when only
    files are there yet, 404 when neither is, 422 for a chat id that cannot exist."""
    joined = requests.join(materialise(chats, "chats"), "chat_id", "left")
    status = (
        F.when(F.coalesce(F.col("chat_id") <= 0, F.lit(True)), 422)
        .when(F.coalesce("has_snapshot", F.lit(False)), 200)
        .when(F.coalesce("has_files", F.lit(False)), 202)
        .otherwise(404)
    )
    return joined.select(*requests.columns, status.cast("long").alias("http_status"))


def live_tokens(issues: DataFrame, asof: Column) -> DataFrame:
    """Tokens that a clean-up at ``asof`` leaves in place."""
    return with_expiry(issues.filter(F.col("issued_at") <= asof)).filter(F.col("expires_at") >= asof)
