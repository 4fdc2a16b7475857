"""Payment webhook bodies: fields, ids, amounts and signatures as column expressions.

A body is parsed once against a schema of the paths of the wanted fields; each field is then the
first match among its ordered paths.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: where each field may sit, in order -------------------------------------------
TYPE_PATHS = ("type", "event", "event_type", "data.type", "data.event")
STATUS_PATHS = (
    "status", "transaction.status", "data.status", "data.transaction.status", "data.payment.status",
)
REFERENCE_PATHS = (
    "reference", "transaction.reference", "transaction.id", "data.reference",
    "data.transaction.reference", "data.transaction.id", "data.payment.reference",
    "data.payment.id",
)
DESCRIPTION_PATHS = (
    "description", "transaction.description", "data.description", "data.transaction.description",
    "data.payment.description",
)
AMOUNT_PATHS = (
    "amount_in_cents", "amount", "transaction.amount_in_cents", "transaction.amount",
    "data.amount_in_cents", "data.amount", "data.transaction.amount_in_cents",
    "data.transaction.amount",
)
EMAIL_PATHS = (
    "payer_email", "customer_email", "payer.email", "customer.email", "transaction.payer_email",
    "transaction.customer_email", "transaction.payer.email", "transaction.customer.email",
    "data.payer_email", "data.customer_email", "data.payer.email", "data.customer.email",
    "data.transaction.payer_email", "data.transaction.customer_email",
    "data.payment.payer_email", "data.payment.customer_email",
)
CHAT_ID_PATHS = (
    "metadata.chat_id", "transaction.metadata.chat_id", "data.metadata.chat_id",
    "data.transaction.metadata.chat_id", "data.payment.metadata.chat_id",
)
CHAT_TEXT_PATHS = (
    "description", "transaction.description", "data.description", "data.transaction.description",
    "data.payment.description", "checkout_url", "data.checkout_url",
    "data.transaction.checkout_url",
)
CHAT_REFERENCE_PATHS = (
    "reference", "transaction.reference", "data.reference", "data.transaction.reference",
    "data.payment.reference", "order_id", "data.order_id",
)
SUCCESS_TYPES = ("transaction.succeeded", "transaction.approved")
SUCCESS_STATUSES = ("succeeded", "success", "approved", "paid", "captured")
CHAT_IN_TEXT = r"(?i)(?:^|[?&\s])chat_id[=:]([0-9]+)"
ORDER_ID = r"(?i)^IF-([0-9]+)-[0-9]+$"
SYNTHETIC_REFERENCE = "bold-chat-"
PSP_EVENT = "transaction.updated"
PSP_APPROVED = ("APPROVED", "COMPLETED")
# ------------------------------------------------------------------------------------------------


#: The paths of each field.
FIELD_PATHS = {
    "type": TYPE_PATHS, "status": STATUS_PATHS, "reference": REFERENCE_PATHS,
    "description": DESCRIPTION_PATHS, "amount_raw": AMOUNT_PATHS, "payer_email": EMAIL_PATHS,
    "chat_id": CHAT_ID_PATHS + CHAT_TEXT_PATHS + CHAT_REFERENCE_PATHS,
}


def body_schema(fields: tuple[str, ...]) -> str:
    """Schema of the fields' paths: text leaves, and variant leaves for amounts (which may be null)."""
    tree: dict = {}
    for path in dict.fromkeys(p for f in fields for p in FIELD_PATHS[f]):
        *parents, leaf = path.split(".")
        node = tree
        for name in parents:
            node = node.setdefault(name, {})
        node[leaf] = "variant" if path in AMOUNT_PATHS else "string"

    def ddl(node: dict) -> str:
        return ", ".join(
            f"`{k}`: struct<{ddl(v)}>" if isinstance(v, dict) else f"`{k}`: {v}"
            for k, v in node.items()
        )

    return f"struct<{ddl(tree)}>"


def parse_body(raw: Column, fields: tuple[str, ...] = tuple(FIELD_PATHS)) -> Column:
    return F.from_json(raw, body_schema(fields))


def _field(body: Column, path: str) -> Column:
    for name in path.split("."):
        body = body.getField(name)
    return body


def _strip(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t\n\r\x0b\x0c\x85\xa0"))


def _first(values: list[Column], use, keep) -> Column:
    """First of ``use(value)`` that passes ``keep``; the expression is compiled only once."""
    return F.get(F.filter(F.transform(F.array_compact(F.array(*values)), use), keep), F.lit(0))


def first_text(body: Column, paths: tuple[str, ...]) -> Column:
    """First non-blank value among the paths, trimmed; empty when there is none."""
    found = _first([_field(body, p) for p in paths], _strip, lambda v: v != "")
    return F.coalesce(found, F.lit(""))


def variant_amount(value: Column) -> Column:
    """Whole part of a JSON number; null and text that is no number count as 0."""
    number = F.try_variant_get(value, "$", "double")
    whole = F.when(F.abs(number) < 9e18, number.cast("bigint"))
    return F.coalesce(whole, F.lit(0).cast("bigint"))


def first_amount(body: Column) -> Column:
    """Whole number at the first path that exists, whatever its value; 0 when none does."""
    return variant_amount(F.coalesce(*[_field(body, p) for p in AMOUNT_PATHS]))


def payer_email(body: Column) -> Column:
    """Lower-case payer address, or empty when it is not shaped like one."""
    email = F.lower(first_text(body, EMAIL_PATHS))
    shaped = email.rlike(r"^[^@]+@.*\.") & ~email.rlike(r"[ \t\n]") & (F.octet_length(email) <= 320)
    return F.when(shaped, email).otherwise("")


def is_success(kind: Column, status: Column) -> Column:
    kind, status = F.lower(_strip(kind)), F.lower(_strip(status))
    return kind.isin(*SUCCESS_TYPES) | status.isin(*SUCCESS_STATUSES)


def _positive(c: Column) -> Column:
    text = _strip(c)
    number = F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint"))
    return F.when(number > 0, number)


def _chat_in_text(c: Column) -> Column:
    query = F.regexp_extract(_strip(c), r"\?(?:[^#]*&)?chat_id=(\d+)(?:[&#]|$)", 1)
    return F.coalesce(_positive(query), _positive(F.regexp_extract(_strip(c), CHAT_IN_TEXT, 1)))


def chat_id(body: Column) -> Column:
    """Chat id from metadata, else from a description or URL, else from a reference."""
    def known(v: Column) -> Column:
        return v.isNotNull()

    def from_reference(text: Column) -> Column:
        order = _positive(F.regexp_extract(_strip(text), ORDER_ID, 1))
        return F.coalesce(order, _positive(text), _chat_in_text(text))

    return F.coalesce(
        _first([_field(body, p) for p in CHAT_ID_PATHS], _positive, known),
        _first([_field(body, p) for p in CHAT_TEXT_PATHS], _chat_in_text, known),
        _first([_field(body, p) for p in CHAT_REFERENCE_PATHS], from_reference, known),
    )


def whole_pesos(amount: Column) -> Column:
    """Gateway amounts in whole pesos: large round ones come in cents."""
    cents = (amount >= 1_000_000) & (amount % 100 == 0)
    return (
        F.when(amount <= 0, F.lit(0).cast("bigint"))
        .when(cents, F.floor(amount / 100).cast("bigint"))
        .otherwise(amount)
    )


def matches_price(amount: Column, price: int) -> Column:
    return amount > 0 if price <= 0 else whole_pesos(amount) == price


def checkout_hash(order_id: Column, amount: Column, currency: Column, secret: str) -> Column:
    return F.sha2(F.concat(order_id, amount.cast("string"), currency, F.lit(secret)), 256)


def hmac_sha256(body: Column, secret: str) -> Column:
    """HMAC-SHA256 of a text as hex, from two SHA-256 rounds with the padded key."""
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner_pad, outer_pad = (F.lit(bytes(b ^ x for b in key)) for x in (0x36, 0x5C))
    inner = F.unhex(F.sha2(F.concat(inner_pad, body.cast("binary")), 256))
    return F.sha2(F.concat(outer_pad, inner), 256)


def signature_ok(body: Column, header: Column, secret: str) -> Column:
    """Accepts hex, ``sha256=`` hex or base64; an empty secret or header never passes."""
    secret = secret.strip()
    if not secret:
        return F.lit(False)
    given = F.regexp_replace(_strip(F.coalesce(header, F.lit(""))), "^sha256=", "")
    expected = hmac_sha256(body, secret)
    as_base64 = F.lower(F.hex(F.try_to_binary(given, F.lit("base64"))))
    hexish = given.rlike(r"^([0-9a-fA-F]{2})+$")
    return (given != "") & F.coalesce(
        F.when(hexish, F.lower(given) == expected).otherwise(as_base64 == expected), F.lit(False)
    )


PSP_SCHEMA = (
    "struct<event: string, timestamp: bigint, signature: struct<properties: array<string>, checksum: string>, "
    "data: struct<transaction: struct<reference: string, status: string, amount_in_cents: variant, "
    "customer_email: string>>>"
)


def parse_psp_body(raw: Column) -> Column:
    return F.from_json(raw, PSP_SCHEMA)


def property_checksum(raw: Column, body: Column, secret: str) -> Column:
    """SHA-256 over the values of the listed properties, the timestamp and the secret."""
    listed = _field(body, "signature.properties")

    def value(path: Column) -> Column:
        full = F.when(path.startswith("data."), path).otherwise(F.concat(F.lit("data."), path))
        found = F.call_function("get_json_object", raw, F.concat(F.lit("$."), full))
        return F.coalesce(found, F.lit(""))

    stamp = F.coalesce(_field(body, "timestamp"), F.lit(0).cast("bigint"))
    text = F.concat(
        F.array_join(F.transform(listed, value), ""), stamp.cast("string"), F.lit(secret.strip())
    )
    return F.when(F.size(listed) > 0, F.sha2(text, 256))


def checksum_ok(body: Column, header: Column, computed: Column, secret: str) -> Column:
    """An empty secret passes; otherwise the header, else the body's checksum, must match."""
    if not secret.strip():
        return F.lit(True)
    given = F.coalesce(
        F.nullif(_strip(header), F.lit("")),
        F.nullif(_strip(_field(body, "signature.checksum")), F.lit("")),
    )
    return F.coalesce(F.lower(given) == computed, F.lit(False))
