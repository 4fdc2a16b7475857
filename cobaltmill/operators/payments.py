"""Payment event log: normalised events, state per reference, outcome per event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cobaltmill.functions import vocab
from cobaltmill.functions import webhooks as H
from cobaltmill.operators.ordering import positions
from cobaltmill.session import computed_once, materialise


FIELDS = {
    "type": lambda v: H.first_text(v, H.TYPE_PATHS),
    "status": lambda v: H.first_text(v, H.STATUS_PATHS),
    "reference": lambda v: H.first_text(v, H.REFERENCE_PATHS),
    "description": lambda v: H.first_text(v, H.DESCRIPTION_PATHS),
    "amount_raw": H.first_amount,
    "chat_id": H.chat_id,
    "payer_email": H.payer_email,
}


def normalise_events(log: DataFrame, body: str = "body", fields: tuple[str, ...] = tuple(FIELDS)) -> DataFrame:
    """The wanted billing fields of each raw webhook body; every body is parsed once for their paths.

    With ``type`` and ``status`` comes ``is_success``.
    """
    v = F.col("__v")
    parsed = computed_once(log, H.parse_body(F.col(body), fields), "__v").withColumns(
        {name: FIELDS[name](v) for name in fields}).drop("__v")
    if {"type", "status"} <= set(fields):
        parsed = parsed.withColumn("is_success", H.is_success(F.col("type"), F.col("status")))
    return parsed


def psp_events(log: DataFrame, body: str = "body") -> DataFrame:
    """Transaction updates of the second gateway that carry a reference and a status."""
    change = F.col("__v.data.transaction")
    parsed = computed_once(log, H.parse_psp_body(F.col(body)), "__v").filter(F.col("__v.event") == H.PSP_EVENT)
    fields = parsed.withColumns({
        "reference": change["reference"],
        "status": change["status"],
        "amount_raw": H.variant_amount(change["amount_in_cents"]),
        "customer_email": F.coalesce(change["customer_email"], F.lit("")),
    })
    return fields.filter((F.col("reference") != "") & (F.col("status") != "")).drop("__v")


def audit_checksums(log: DataFrame, header: Column, secret: str, body: str = "body") -> DataFrame:
    """Adds the computed ``checksum`` of each body and whether the given one matches."""
    parsed = computed_once(log, H.parse_psp_body(F.col(body)), "__v")
    computed = parsed.withColumn("checksum", H.property_checksum(F.col(body), F.col("__v"), secret))
    verdict = H.checksum_ok(F.col("__v"), header, F.col("checksum"), secret)
    return computed.withColumn("checksum_ok", verdict).drop("__v")


def payment_fold(events: DataFrame, strict_reference: bool = False) -> DataFrame:
    """State per reference from events (reference, ts, event_id, is_success, amount, chat_id,
    payer_email).

    A success pays a reference for good and later successes are repeats. With ``strict_reference`` a
    later failure turns it to failed, and a success after that pays it again; payer and chat stay with
    the first paying success that names them, and ``paid_at`` is that of the last paying one. Everything
    is a combinable aggregate, so a busy reference costs one row per task.
    """
    position = F.struct("ts", "event_id")
    email = F.nullif(F.col("payer_email"), F.lit(""))
    if strict_reference:
        events = _opening_successes(events)
        pays = F.col("opens")
        status = F.max_by("is_success", position)
        named = F.min_by(email, F.when(pays & email.isNotNull(), position))
        chat = F.min_by("chat_id", F.when(pays & F.col("chat_id").isNotNull(), position))
        paid_at = F.max(F.when(pays, F.col("ts")))
        repeats = F.count_if(F.col("is_success") & ~pays)
    else:
        pays = F.col("is_success")
        first = F.when(pays, position)
        status, named, chat = F.bool_or(pays), F.min_by(email, first), F.min_by("chat_id", first)
        paid_at = F.min(first)["ts"]
        repeats = F.greatest(F.count_if(pays) - 1, F.lit(0))
    state = events.groupBy("reference").agg(
        F.when(status, "paid").otherwise("failed").alias("status"), paid_at.alias("paid_at"),
        F.min_by("amount", position).alias("amount"), chat.alias("payer_chat_id"),
        named.alias("payer_email"), repeats.alias("already_processed"), F.count(F.lit(1)).alias("n_events"),
    )
    return state


def _opening_successes(events: DataFrame) -> DataFrame:
    """Marks successes that come first or right after a failure of their reference (``opens``).

    The events are numbered in one global order, so that a busy reference is spread over many tasks,
    and each is joined with the one before it.
    """
    narrow = events.select("reference", "ts", "event_id", "is_success", "amount", "chat_id", "payer_email")
    placed = materialise(positions(narrow, [F.col("reference"), F.col("ts"), F.col("event_id")], "__at"), "events")
    before = placed.select((F.col("__at") + 1).alias("__at"), F.col("reference").alias("__reference"),
                           F.col("is_success").alias("__paid"))
    joined = placed.join(before, "__at", "left")
    still_paid = F.coalesce((F.col("__reference") == F.col("reference")) & F.col("__paid"), F.lit(False))
    return joined.withColumn("opens", F.col("is_success") & ~still_paid)


def payment_outcome(events: DataFrame, price: int = vocab.PREMIUM_PRICE) -> DataFrame:
    """Outcome of each normalised event; expects ``signature_ok``, ``ts`` and ``event_id``.

    Repeats are found by comparing with the first paying event of the reference, an aggregate.
    """
    synthetic = F.concat(F.lit(H.SYNTHETIC_REFERENCE), F.col("chat_id").cast("string"))
    routed = events.withColumn(
        "payment_reference", F.coalesce(F.nullif(F.col("reference"), F.lit("")), synthetic)
    ).withColumn(
        "gate",
        F.when(~F.col("signature_ok"), "bad_signature")
        .when(~F.col("is_success"), "unsuccessful")
        .when(~H.matches_price(F.col("amount_raw"), price), "wrong_amount")
        .when(F.col("chat_id").isNull(), "missing_chat_id")
        .otherwise("pays"),
    )
    position = F.struct("ts", "event_id")
    firsts = routed.filter(F.col("gate") == "pays").groupBy("payment_reference").agg(
        F.min(position).alias("__first")
    )
    outcome = F.when(position == F.col("__first"), "activated").otherwise("duplicate")
    paying = routed.filter(F.col("gate") == "pays").join(materialise(firsts, "first-payments"), "payment_reference")
    others = routed.filter(F.col("gate") != "pays").withColumnRenamed("gate", "outcome")
    return paying.withColumn("outcome", outcome).drop("__first", "gate").unionByName(others)
