"""Literal cases for the column expressions."""

import datetime as dt
import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from cobaltmill.functions import clock
from cobaltmill.functions import numbers as N
from cobaltmill.functions import prefixes as X
from cobaltmill.functions import text as T
from cobaltmill.functions import webhooks as H


def one(spark, value, use, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(use(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("text, expected", [
    ("10.500.000", 10500000.0), ("10.500", 10500.0), ("100.5", 100.5), ("10.500,50", 10500.5),
    ("10500,50", 10500.5), ("10,500,000", 10500000.0), ("$ 1.234", 1234.0), ("", None),
    ("10-5", None), ("1,234.56", 1.23456), ("-2.500", -2500.0), ("-", None), (None, None),
])
def test_pesos(spark, text, expected):
    assert one(spark, text, N.parse_cop) == expected


@pytest.mark.parametrize("text, expected", [
    ("1,234.56", 1234.56), ("US$ 99", 99.0), ("-", None), ("1.5d", 1.5), ("abc", None),
])
def test_dollars(spark, text, expected):
    assert one(spark, text, N.parse_usd) == expected


@pytest.mark.parametrize("text, expected", [
    ("900.123.456-7", "900123456"), ("12 345 678", "12345678"), ("ABC", "ABC"), ("", ""),
    ("x1234567890123", "1234567890"),
])
def test_identifiers(spark, text, expected):
    assert one(spark, text, N.id_normalize) == expected


@pytest.mark.parametrize("text, expected", [
    ("3/4/2024", dt.datetime(2024, 4, 3)), ("2024-04-03", dt.datetime(2024, 4, 3)),
    ("31-12-2023 7:05", None), ("31/12/2023 7:05", dt.datetime(2023, 12, 31, 7, 5)),
    ("31/31/2023", None), ("n/a", None), ("3.4.2024", dt.datetime(2024, 4, 3)),
    ("2024-01-02T03:04:05Z", dt.datetime(2024, 1, 2, 3, 4, 5)), ("2024-01-02T03:04:05.123", dt.datetime(2024, 1, 2, 3, 4, 5, 123000)),
    ("2024-01-02T03:04:05.5+02:00", dt.datetime(2024, 1, 2, 1, 4, 5, 500000)), ("01/02/24", dt.datetime(2024, 2, 1)),
    ("1-2-99", dt.datetime(1999, 2, 1)), ("Jan 2, 2024", dt.datetime(2024, 1, 2)), ("2 january 2024", dt.datetime(2024, 1, 2)),
    ("02-FEB-2024", dt.datetime(2024, 2, 2)), ("20240102", dt.datetime(2024, 1, 2)), ("20241340", None), ("Foo 2, 2024", None),
])
def test_dates(spark, text, expected):
    assert one(spark, text, N.parse_date) == expected


@pytest.mark.parametrize("text, expected", [
    ("  a \t\n b  c ", "a b c"), ("a b", "a b"), (" ", ""), ("a\x1fb", "a b"),
])
def test_norm_text(spark, text, expected):
    assert one(spark, text, T.norm_text) == expected


def test_strip_accents(spark):
    assert one(spark, "Bogotá ÑANDÚ ç é ø", T.strip_accents) == "Bogota NANDU c e ø"


def test_fences(spark):
    assert one(spark, "x ```python\nprint('¡hola!')\n``` y", T.extract_fenced) == "print('# hola!')"
    assert one(spark, "﻿a ``` b", T.extract_fenced) == "a  b"
    assert one(spark, "# pd.\n\n  # import pandas", T.code_like) is False
    assert one(spark, "# nota\nimport pandas as pd", T.code_like) is True


@pytest.mark.parametrize("text, expected", [
    ('t\n```echarts-json\n{"echarts_option": {"k": 1}}\n```', 1), ('```ECHARTS-JSON {"k": 2}```', 2),
    ('ECHARTS_JSON_OUTPUT:{}\n ECHARTS_JSON_OUTPUT: {"k": 3}', 3), ("ECHARTS_JSON_OUTPUT:{", None),
    ('```echarts-json [1] ```', None), ('```echarts-json {"echarts_option": 5} ```', None), ("", None),
])
def test_chart_json(spark, text, expected):
    assert one(spark, text, lambda c: F.try_variant_get(T.chart_json(c), "$.k", "int")) == expected


def test_json_from_text(spark):
    def as_json(c):
        return F.to_json(T.json_from_text(c))

    assert json.loads(one(spark, 'x {"a": {"b": 1}} y', as_json)) == {"a": {"b": 1}}
    assert one(spark, "no object", as_json) == "{}"
    assert one(spark, '```json\n{"a": 1,}\n```', as_json) == "{}"


def test_local_days(spark):
    def bogota(*parts):
        return dt.datetime(*parts) + dt.timedelta(hours=5)

    pairs = [(bogota(2026, 7, 9, 23), bogota(2026, 7, 10, 1)), (bogota(2026, 7, 9, 8), bogota(2026, 7, 9, 23))]
    df = spark.createDataFrame(pairs, "a timestamp_ntz, b timestamp_ntz")
    rows = df.select(clock.same_local_day(F.col("a"), F.col("b")).alias("s"), clock.next_reset(F.col("a")).alias("n"))
    assert [tuple(r) for r in rows.collect()] == [
        (False, dt.datetime(2026, 7, 10, 5)), (True, dt.datetime(2026, 7, 10, 5))]


def test_local_days_ignore_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert one(spark, dt.datetime(2026, 7, 10, 4, 59), clock.local_day, "timestamp_ntz") == dt.date(2026, 7, 9)
        assert one(spark, dt.datetime(2026, 7, 10, 5, 0), clock.local_day, "timestamp_ntz") == dt.date(2026, 7, 10)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("raw, expected", [(40000, 40000), (4000000, 40000), (0, 0), (-1, 0), (50000, 50000)])
def test_whole_pesos(spark, raw, expected):
    assert one(spark, raw, H.whole_pesos, "bigint") == expected


@pytest.mark.parametrize("raw, expected", [(40000, True), (4000000, True), (30000, False)])
def test_price(spark, raw, expected):
    assert one(spark, raw, lambda c: H.matches_price(c, 40000), "bigint") is expected


@pytest.mark.parametrize("body, expected", [
    ('{"reference":"70815","status":"succeeded"}', 70815),
    ('{"description":"Plan Pro ?chat_id=55501","amount":40000}', 55501),
    ('{"reference":"IF-70815-991"}', 70815),
    ('{"data":{"metadata":{"chat_id":7}},"reference":"9"}', 7),
    ('{"checkout_url":"https://x.co/p?a=1&chat_id=31#z"}', 31),
    ('{"description":"chat_id:55 gracias"}', 55), ('{"reference":"-4"}', None), ("{}", None),
])
def test_chat_id(spark, body, expected):
    assert one(spark, body, lambda c: H.chat_id(H.parse_body(c))) == expected


@pytest.mark.parametrize("body, expected", [
    ('{"payer_email":"Eva@Correo.CO"}', "eva@correo.co"), ('{"data":{"payer_email":"luz@empresa.net"}}', "luz@empresa.net"),
    ('{"customer":{"email":"k@w.org"}}', "k@w.org"), ('{"data":{"transaction":{"customer_email":"p@q.info"}}}', "p@q.info"),
    ('{"payer_email":"  fin@sitio.com  "}', "fin@sitio.com"), ('{"status":"approved"}', ""),
    ('{"payer_email":"nada"}', ""), ('{"payer_email":"m@n"}', ""), ('{"payer_email":"x y@sitio.com"}', ""),
    ('{"payer_email":"@x.co"}', ""), ('{"payer_email":"%s@x.co"}' % ("a" * 320), ""),
])
def test_payer_email(spark, body, expected):
    assert one(spark, body, lambda c: H.payer_email(H.parse_body(c))) == expected


@pytest.mark.parametrize("body, expected", [
    ('{"amount_in_cents":null,"amount":5}', 0), ('{"amount":"77"}', 77), ('{"amount":12.9}', 12),
    ('{"data":{"transaction":{"amount":9}}}', 9), ("{}", 0), ('{"amount_in_cents":0,"amount":5}', 0),
])
def test_amount(spark, body, expected):
    assert one(spark, body, lambda c: H.first_amount(H.parse_body(c))) == expected


def test_signatures(spark):
    body, secret = '{"a":"ñ"}', "dummy"
    mac = hmac.new(secret.encode(), body.encode(), hashlib.sha256)
    import base64

    for header, good in (
        (mac.hexdigest(), True), ("sha256=" + mac.hexdigest().upper(), True), ("", False),
        (base64.b64encode(mac.digest()).decode(), True), ("00" + mac.hexdigest()[2:], False), ("zz", False),
    ):
        assert one(spark, body, lambda c: H.signature_ok(c, F.lit(header), secret)) is good
    assert one(spark, body, lambda c: H.signature_ok(c, F.lit(mac.hexdigest()), " ")) is False
    long_key = "k" * 100
    expected = hmac.new(long_key.encode(), body.encode(), hashlib.sha256).hexdigest()
    assert one(spark, body, lambda c: H.hmac_sha256(c, long_key)) == expected


def _mod10(prefix):
    total = 0
    for i, d in enumerate(reversed(prefix)):
        n = int(d) * (2 if i % 2 == 0 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def test_prefixes(spark):
    texts = [str(n) for n in (399999, 400000, 455000, 500000, 509999, 510000, 12345, 12345678)] + ["40000a", "abc"]
    rows = spark.createDataFrame([(t,) for t in texts], "p string").select(
        "p", X.country(F.col("p")).alias("c"), X.brand(F.col("p")).alias("b"), X.level(F.col("p")).alias("l"))
    for r in rows.collect():
        digits = r["p"].isdigit()
        shaped = digits and 6 <= len(r["p"]) <= 8
        assert r["l"] == ("LOW" if not shaped else "HIGH" if _mod10(r["p"]) else "MEDIUM")
        lead = int(r["p"][:6]) if r["p"][:6].isdigit() else -1
        assert r["c"] == ("US" if 400000 <= lead <= 499999 else "BR" if 500000 <= lead <= 509999 else "UNKNOWN")
    assert one(spark, " 1234567890123456 ", X.read_prefix) is None
    assert one(spark, " 12345678 ", X.read_prefix) == "12345678"


def test_sql_functions_agree_with_the_expressions(spark):
    from cobaltmill.plans.surface import register_sql_functions

    register_sql_functions(spark)
    texts = ["10.500.000", "10.500", "100.5", "10.500,50", "10500,50", "10,500,000", "$ 1.234", "", "10-5",
             "900.123.456-7", "12 345 678", "ABC", " a \t b ", None, "1,234.56", "-"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    df.createOrReplaceTempView("texts")
    ours = df.select(
        N.parse_cop(F.col("s")).alias("c"), N.parse_usd(F.col("s")).alias("u"),
        N.id_normalize(F.col("s")).alias("i"), T.norm_text(F.col("s")).alias("n")).collect()
    theirs = spark.sql("SELECT parse_cop(s) c, parse_usd(s) u, id_normalize(s) i, norm_text(s) n FROM texts").collect()
    assert list(map(tuple, ours)) == list(map(tuple, theirs))
