"""Users, premium plans and the daily message quota, as batch jobs over event logs.

Messages are (user_id, ts, event_id); payments are (user_id, ts). A local day is a day of the
quota time zone. All per-user work combines map-side or is limited before the shuffle, so one
very busy user does not land whole in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cobaltmill.functions import clock, vocab
from cobaltmill.operators.ordering import first_n, locf
from cobaltmill.session import materialise


#: A block of time holds 2^33 half microseconds, a bit over an hour; a year has some 7000 blocks.
PERIOD_BITS = 33


def premium_since(payments: DataFrame, revokes: DataFrame | None = None) -> DataFrame:
    """First payment of each user; with revokes, the first one after the last revoke. Stored."""
    if revokes is None:
        first = payments.groupBy("user_id").agg(F.min("ts").alias("premium_since"))
        return materialise(first, "premium-since")
    last = revokes.groupBy("user_id").agg(F.max("ts").alias("__revoked"))
    valid = F.col("__revoked").isNull() | (F.col("ts") > F.col("__revoked"))
    last = materialise(last, "revokes")
    return premium_since(payments.join(last, "user_id", "left").filter(valid))


def with_premium(events: DataFrame, since: DataFrame) -> DataFrame:
    """Adds ``is_premium``: had the user paid by the time of the event?"""
    joined = events.join(since, "user_id", "left")
    paid = F.coalesce(F.col("ts") >= F.col("premium_since"), F.lit(False))
    return joined.withColumn("is_premium", paid).drop("premium_since")


def premium_by_periods(events: DataFrame, changes: DataFrame, block_bits: int = PERIOD_BITS) -> DataFrame:
    """Adds ``is_premium`` and ``since``: the user's last grant or revoke at or before each event (user_id, ts).

    ``changes`` (user_id, ts, change_id, active) may open and close any number of periods. Of changes at one time
    the one with the largest id holds. ``since`` is the time of that change, null before the first one.

    Events and changes are cut into blocks of time. What holds at the start of a block is carried over a table
    of one row per user and block, so a user's events are ordered within blocks only.
    """
    last = changes.filter("user_id is not null and ts is not null").groupBy("user_id", "ts").agg(
        F.max_by(F.struct("active", "ts"), "change_id").alias("__state"))
    columns = events.columns
    kind = last.schema["__state"].dataType
    at = F.unix_micros(F.col("ts").cast("timestamp")) * 2
    marks = last.select("user_id", at.alias("__at"), "__state", F.lit(None).cast(events.schema).alias("__row"))
    rows = events.select("user_id", F.coalesce(at + 1, F.lit(-1)).alias("__at"), F.lit(None).cast(kind).alias("__state"),
                         F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__row"))
    held = locf(rows.unionByName(marks), "__at", ["__state"], ["user_id"], bits=block_bits).filter("__row is not null")
    known = F.col("__state").isNotNull() & F.col("__row.ts").isNotNull()
    return held.select(
        *[F.col("__row").getField(c).alias(c) for c in columns],
        F.coalesce(known & F.col("__state.active"), F.lit(False)).alias("is_premium"),
        F.when(known, F.col("__state.ts")).alias("since"))


def daily_quota(messages: DataFrame, since: DataFrame, limit: int = vocab.DAILY_LIMIT,
                zone: str = vocab.QUOTA_ZONE, used: DataFrame | None = None) -> DataFrame:
    """Outcome of each message: premium, admitted (the first ``limit`` of the day) or refused.

    ``used`` (user_id, local_day, admitted) holds what earlier batches admitted already.

    The last admitted position of each user and day is found with a limited ranking; messages
    are then compared with it, so no user's day is ever sorted as a whole.
    """
    marked = with_premium(messages, since).withColumn("local_day", clock.local_day(F.col("ts"), zone))
    position = F.struct("ts", "event_id")
    ranked = first_n(
        marked.filter(~F.col("is_premium")).select("user_id", "local_day", "ts", "event_id"),
        ["user_id", "local_day"], [F.col("ts"), F.col("event_id")], limit,
    )
    if used is not None:
        spent = F.coalesce("admitted", F.lit(0))
        ranked = ranked.join(used, ["user_id", "local_day"], "left").filter(
            F.col("rank") <= F.lit(limit) - spent
        )
    cutoff = ranked.groupBy("user_id", "local_day").agg(F.max(position).alias("last_admitted"))
    cutoff = materialise(cutoff, "cutoffs")
    outcome = (
        F.when(F.col("is_premium"), "premium")
        .when(position <= F.col("last_admitted"), "admitted")
        .otherwise("refused")
    )
    return marked.join(cutoff, ["user_id", "local_day"], "left").select(
        *messages.columns, "local_day", outcome.alias("outcome")
    )


def quota_state(messages: DataFrame, since: DataFrame, asof: Column,
                limit: int = vocab.DAILY_LIMIT, zone: str = vocab.QUOTA_ZONE) -> DataFrame:
    """Counters per user at an instant. Refused messages never count, so a day adds min(n, limit)."""
    free = with_premium(messages.filter(F.col("ts") <= asof), since)
    per_day = free.groupBy("user_id", clock.local_day(F.col("ts"), zone).alias("local_day")).agg(
        F.least(F.count_if(~F.col("is_premium")), F.lit(limit)).alias("counted")
    )
    today = F.col("local_day") == clock.local_day(asof, zone)
    per_user = per_day.groupBy("user_id").agg(
        F.coalesce(F.sum(F.when(today, F.col("counted"))), F.lit(0)).alias("messages_today"),
        F.sum("counted").alias("lifetime_messages"),
    )
    paid = since.filter(F.col("premium_since") <= asof)
    premium = F.col("premium_since").isNotNull()
    left = F.greatest(F.lit(limit) - F.col("messages_today"), F.lit(0))
    return per_user.join(paid, "user_id", "left").select(
        "user_id", "messages_today", "lifetime_messages", premium.alias("is_premium"),
        F.when(premium, -1).otherwise(left).cast("long").alias("credits_remaining"),
        (~premium & (F.col("messages_today") >= limit)).alias("paywall"),
        "premium_since",
    )


def billing_status(state: DataFrame, asof: Column, limit: int = vocab.DAILY_LIMIT,
                   zone: str = vocab.QUOTA_ZONE) -> DataFrame:
    """Plan, flags and counters in one row per user."""
    return state.select(
        "user_id", "is_premium", F.when(F.col("is_premium"), "premium").otherwise("free").alias("plan"),
        "messages_today", F.lit(limit).cast("long").alias("daily_limit"), "credits_remaining",
        (~F.col("is_premium")).alias("show_upgrade_button"),
        F.col("is_premium").alias("show_pdf_button"),
        F.col("paywall").alias("paywall_active"), "premium_since",
        clock.next_reset(asof, zone).alias("quota_resets_at"),
    )


def entitlement_gate(requests: DataFrame, since: DataFrame) -> DataFrame:
    """HTTP status of each download: PDF and Excel need premium, all else is free."""
    gated = F.lower("resource_type").isin("pdf", "excel")
    status = F.when(gated & ~F.col("is_premium"), 403).otherwise(200)
    return with_premium(requests, since).withColumn("http_status", status.cast("long"))


def normal_email(c: Column) -> Column:
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


def identity_links(links: DataFrame) -> DataFrame:
    """Final chat and e-mail pairs of a log of links (chat_id, email, ts, event_id).

    A link takes its chat and its e-mail away from every earlier pair, whoever held them. So a
    pair stands exactly when it is the last link of its chat and also the last of its e-mail:
    two combinable aggregates and one join, however long the chains of links are.
    """
    calls = links.withColumn("email", normal_email(F.col("email"))).filter(F.col("email").isNotNull())
    position = F.struct("ts", "event_id")
    per_chat = calls.groupBy("chat_id").agg(
        F.max_by("email", position).alias("email"), F.max(position).alias("at")
    )
    per_email = calls.groupBy("email").agg(F.max(position).alias("at"))
    return per_chat.join(per_email, ["email", "at"]).select(
        "chat_id", "email", F.col("at.ts").alias("linked_at")
    )


def latest_snapshot(events: DataFrame, payload: str) -> DataFrame:
    """Last non-blank payload of each user."""
    filled = events.filter(F.trim(payload) != "")
    return filled.groupBy("user_id").agg(
        F.max_by(payload, F.struct("ts", "event_id")).alias("payload"),
        F.max("ts").alias("saved_at"),
    )


def tier_config(users: DataFrame) -> DataFrame:
    """Report style per user: free users get fixed values, premium ones their branding.

    Expects is_premium, branding_charts (JSON array text), branding_color, branding_color_sec,
    branding_font_body, branding_font_title, primary_color, secondary_color, font_size_body and
    font_size_titles.
    """
    premium = F.col("is_premium")
    all_types = F.array(*[F.lit(t) for t in vocab.CHART_TYPES])
    wanted = F.transform(F.from_json("branding_charts", "array<string>"), lambda t: F.lower(F.trim(t)))
    allowed = F.array_distinct(F.filter(wanted, lambda t: F.array_contains(all_types, t)))
    body = F.when(premium, F.coalesce("branding_font_body", "font_size_body")).otherwise(
        F.col("font_size_body"))
    title = F.when(premium, F.coalesce("branding_font_title", "font_size_titles")).otherwise(
        F.col("font_size_titles"))
    own = F.coalesce(F.nullif(F.trim("branding_color"), F.lit("")), F.nullif("primary_color", F.lit("")))
    second = F.coalesce(F.nullif(F.trim("branding_color_sec"), F.lit("")), F.col("secondary_color"))
    return users.select(
        "user_id", F.when(premium, "premium").otherwise("free").alias("tier"),
        F.array_join(
            F.when(premium & (F.size(allowed) > 0), allowed).otherwise(all_types), ","
        ).alias("chart_types"),
        F.when(premium, F.coalesce(own, F.lit(vocab.PREMIUM_COLOUR)))
        .otherwise(vocab.FREE_COLOUR).alias("primary_color"),
        F.when(premium, second).otherwise(F.col("secondary_color")).alias("secondary_color"),
        F.when(F.coalesce(body, F.lit(0)) < 6, 11).otherwise(body).cast("long").alias("font_size_body"),
        F.when(F.coalesce(title, F.lit(0)) < 8, 16).otherwise(title).cast("long").alias("font_size_titles"),
    )


def upload_audit(uploads: DataFrame) -> DataFrame:
    """Audit rows of uploads whose indexing succeeded."""
    from cobaltmill.sources.files import audit_type, file_name

    done = uploads.filter(F.col("indexed") & F.col("error").isNull())
    return done.select(
        "user_id", file_name(F.col("path")).alias("filename"),
        audit_type(F.col("path")).alias("file_type"), F.col("path").alias("file_path"),
        "size_bytes", "indexed", "indexed_chunks",
    )
