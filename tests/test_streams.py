"""Streams fed in several micro-batches against the batch operators."""

import datetime as dt
from pathlib import Path

from pyspark.sql import functions as F
from test_operators import PAYMENTS, _quota_expected, _quota_rows

from cobaltmill.operators import payments, tokens
from cobaltmill.session import fresh_path
from cobaltmill.streaming import jobs

BASE = dt.datetime(2024, 1, 1)


def feed(spark, df, order, n):
    """Write the rows as ``n`` files whose modification times follow the order."""
    import os
    import time

    folder = Path(fresh_path(spark, "feed").removeprefix("file:"))
    rows = df.orderBy(*order).collect()
    size = -(-len(rows) // n)
    stamp = time.time() - 1000
    for i in range(n):
        part = spark.createDataFrame(rows[i * size:(i + 1) * size], df.schema).coalesce(1)
        target = str(folder / f"part{i}")
        part.write.parquet(target)
        for f in Path(target).glob("*.parquet"):
            os.utime(f, (stamp + i, stamp + i))
    return (
        spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1)
        .option("recursiveFileLookup", "true").parquet(str(folder))
    )


def test_quota_over_many_batches(spark):
    rows, paid = _quota_rows(300), {2: BASE + dt.timedelta(days=2)}
    messages = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz")
    since = spark.createDataFrame(list(paid.items()), "user_id long, premium_since timestamp_ntz")
    stream = feed(spark, messages, ["ts", "event_id"], 5)
    got = jobs.daily_quota_stream(stream, since, fresh_path(spark, "quota"), 4).collect()
    assert {r["event_id"]: r["outcome"] for r in got} == _quota_expected(rows, paid, 4)


def test_quota_continues_after_a_restart(spark):
    rows = sorted(_quota_rows(200), key=lambda r: (r[2], r[0]))
    schema = "event_id long, user_id long, ts timestamp_ntz"
    since = spark.createDataFrame([], "user_id long, premium_since timestamp_ntz")
    source, folder = fresh_path(spark, "feed"), fresh_path(spark, "quota")
    for part in (rows[:70], rows[70:71], rows[71:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        got = jobs.daily_quota_stream(stream, since, folder, 3)
    assert {r["event_id"]: r["outcome"] for r in got.collect()} == _quota_expected(rows, {}, 3)


def test_first_use_is_the_earliest_whatever_the_batches(spark):
    issues = spark.createDataFrame([(1, BASE, "dashboard"), (2, BASE, "chart")], "token long, issued_at timestamp, resource_type string")
    used = [(10, 1, 9), (11, 1, 5), (12, 1, 2), (13, 2, 7), (14, 2, 1), (15, 2, 1)]
    uses = spark.createDataFrame([(i, t, BASE + dt.timedelta(minutes=m)) for i, t, m in used], "use_id long, token long, used_at timestamp")
    for n in (1, 3, 6):
        got = jobs.first_use_stream(feed(spark, uses, ["use_id"], n), issues, fresh_path(spark, "first")).collect()
        assert {(r["token"], r["use_id"], r["used_at"]) for r in got} == {
            (1, 12, BASE + dt.timedelta(minutes=2)), (2, 14, BASE + dt.timedelta(minutes=1))}


def test_quota_of_late_messages(spark):
    rows = [(i, 1, BASE + dt.timedelta(days=9)) for i in range(3)] + [(10 + i, 1, BASE) for i in range(3)]
    messages = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz")
    since = spark.createDataFrame([], "user_id long, premium_since timestamp_ntz")

    def run(**how):
        folder = fresh_path(spark, "quota")
        got = jobs.daily_quota_stream(feed(spark, messages, ["event_id"], 3), since, folder, 2, **how).collect()
        kept = list(Path(f"{folder.removeprefix('file:')}/used").iterdir())
        return {r["event_id"]: r["outcome"] for r in got}, len(kept)

    outcomes, kept = run()
    assert outcomes == _quota_expected(rows, {}, 2) and kept == 2
    assert {k: v for k, v in run(late_days=2)[0].items() if k >= 10} == {10: "late", 11: "late", 12: "late"}


def test_payments_over_many_batches(spark):
    df = spark.createDataFrame(
        [(r, BASE + dt.timedelta(minutes=m), i, ok, a, c, e) for i, (r, m, ok, a, c, e) in enumerate(PAYMENTS)],
        "reference string, ts timestamp_ntz, event_id long, is_success boolean, amount long, chat_id long, payer_email string")
    got = jobs.payment_fold_stream(feed(spark, df, ["ts", "event_id"], 4), fresh_path(spark, "pay"))
    want = payments.payment_fold(df)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_webhook_log_stream(spark):
    from cobaltmill.streaming.sources import json_log_stream

    folder = fresh_path(spark, "log")
    bodies = ['{"type":"transaction.approved","reference":"77","amount":40000}', "not json", '{"status":"declined"}']
    spark.createDataFrame([(b,) for b in bodies], "value string").write.text(folder)
    out = fresh_path(spark, "events")
    events = payments.normalise_events(json_log_stream(spark, folder))
    jobs._run(events.writeStream.format("parquet").option("path", f"{out}/rows"), out)
    rows = spark.read.parquet(f"{out}/rows").collect()
    assert {(r["reference"], r["chat_id"], r["amount_raw"], r["is_success"]) for r in rows} == {
        ("77", 77, 40000, True), ("", None, 0, False)}
    assert len(rows) == 3


def test_tokens_over_many_batches(spark):
    issued = [(t, BASE + dt.timedelta(minutes=5 * t), "dashboard" if t % 2 else "chart") for t in range(60)]
    used = [(1000 + i, t, BASE + dt.timedelta(minutes=5 * t + m)) for i, (t, m) in
            enumerate([(1, 3), (1, 4), (3, 14), (5, 16), (4, 29), (8, 31), (59, 1)])]
    issues = spark.createDataFrame(issued, "token long, issued_at timestamp, resource_type string")
    uses = spark.createDataFrame(used, "use_id long, token long, used_at timestamp")
    live = {r["token"] for r in tokens.resolve_uses(uses, issues).filter("is_live").collect()}
    assert live == {1, 3, 4, 59}
    firsts = jobs.first_use_stream(feed(spark, uses, ["used_at"], 3), issues, fresh_path(spark, "first")).collect()
    assert {r["token"]: r["use_id"] for r in firsts} == {1: 1000, 3: 1002, 4: 1004, 59: 1006} and len(firsts) == len(live)

    joined = jobs.token_expiry_stream(
        feed(spark, issues, ["issued_at"], 3), feed(spark, uses, ["used_at"], 3), fresh_path(spark, "expiry"))
    assert {(r["token"], r["use_id"]) for r in joined.filter(F.col("use_id").isNotNull()).collect()} == {
        (1, 1000), (1, 1001), (3, 1002), (4, 1004), (59, 1006)}
    expired = {r["token"] for r in joined.filter(F.col("use_id").isNull()).collect()}
    assert {0, 2, 5, 8} <= expired and not expired & live


STRICT = "reference string, ts timestamp_ntz, event_id long, is_success boolean, amount long, chat_id long, payer_email string"


def _strict_events(n, seed=3):
    import random

    rnd = random.Random(seed)
    rows = [("hot" if rnd.random() < 0.3 else f"r{rnd.randrange(12)}", BASE + dt.timedelta(minutes=rnd.randrange(600)), i,
             rnd.random() < 0.6, rnd.randrange(5), rnd.choice([None, 1, 2]), rnd.choice(["", None, "a@x.co", "b@x.co"]))
            for i in range(n)]
    return rows + [(None, BASE, n, True, 1, 1, "")]


def test_strict_payments_over_shuffled_batches_and_a_restart(spark):
    import random

    rows = _strict_events(400)
    want = sorted(map(str, payments.payment_fold(spark.createDataFrame(rows, STRICT).fillna("", "reference"), True).collect()))
    random.Random(4).shuffle(rows)
    source, folder = fresh_path(spark, "feed"), fresh_path(spark, "strict")
    for part in (rows[:150], rows[150:151], rows[151:]):
        spark.createDataFrame(part, STRICT).repartition(2).write.mode("append").parquet(source)
        stream = spark.readStream.schema(STRICT).option("maxFilesPerTrigger", 1).parquet(source)
        got = jobs.strict_payment_stream(stream, folder)
    columns = payments.payment_fold(spark.createDataFrame([], STRICT), True).columns
    assert sorted(map(str, got.select(*columns).collect())) == want


def test_strict_payments_settle_behind_the_watermark_and_leave(spark):
    day = dt.timedelta(days=1)
    rows = [("a", BASE, 1, True, 5, 1, ""), ("a", BASE + day, 2, False, 5, 1, ""), ("b", BASE + 9 * day, 3, True, 7, 2, "b@x.co"),
            ("late", BASE, 4, True, 1, 1, ""), ("a", BASE + 10 * day, 5, True, 5, 4, "n@x.co"), ("b", BASE + 30 * day, 6, False, 7, 2, "")]
    stream = feed(spark, spark.createDataFrame(rows, STRICT), ["event_id"], 6)
    folder = fresh_path(spark, "strict")
    got = {r["reference"]: r for r in jobs.strict_payment_stream(stream, folder, 2 * day, 3 * day).collect()}
    assert set(got) == {"a", "b"}  # the late one is behind the watermark
    assert (got["a"]["status"], got["a"]["n_events"], got["a"]["payer_chat_id"]) == ("paid", 1, 4)  # begun anew
    assert (got["b"]["status"], got["b"]["n_events"]) == ("failed", 2)  # the watermark had not reached its first event
    kept = spark.read.format("statestore").load(f"{folder}/checkpoint")
    assert kept.count() == 1  # only b's, whose last event is behind no watermark yet


def test_strict_payments_keep_references_by_buckets(spark):
    import json

    day = dt.timedelta(days=1)
    rows = [(f"r{i % 700}", BASE + dt.timedelta(minutes=(i * 37) % 900), i, i % 3 > 0, i % 5, i % 4 or None, "") for i in range(2_000)]
    df = spark.createDataFrame(rows, STRICT)
    folder, want = fresh_path(spark, "strict"), payments.payment_fold(df, True)
    got = jobs.strict_payment_stream(feed(spark, df, ["event_id"], 3), folder, buckets=5)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    assert spark.read.format("statestore").load(f"{folder}/checkpoint").count() == 5  # not one state a reference

    # references of one bucket settle, leave and begin anew each by itself
    rows = [("a", BASE, 1, True, 5, 1, ""), ("c", BASE + 8 * day, 2, True, 5, 1, ""), ("b", BASE + 9 * day, 3, True, 7, 2, "b@x.co"),
            ("c", BASE, 4, False, 1, 1, ""), ("a", BASE + 10 * day, 5, True, 5, 4, ""), ("c", BASE + 11 * day, 6, False, 7, 2, "")]
    folder = fresh_path(spark, "strict")
    stream = feed(spark, spark.createDataFrame(rows, STRICT), ["event_id"], 6)
    got = {r["reference"]: r for r in jobs.strict_payment_stream(stream, folder, 2 * day, 3 * day, buckets=1).collect()}
    assert {r: (g["status"], g["n_events"], g["payer_chat_id"]) for r, g in got.items()} == {
        "a": ("paid", 1, 4), "b": ("paid", 1, 2), "c": ("failed", 2, 1)}
    kept = [json.loads(r["value"]["groupState"]["references"]) for r in spark.read.format("statestore").load(f"{folder}/checkpoint").collect()]
    assert [sorted(k) for k in kept] == [["a", "b", "c"]] and kept[0]["c"][0]["n"] == 1  # its event at day 8 is settled


def test_sessions_batch_and_stream(spark):
    import random

    from cobaltmill.operators.sessions import sessions

    rnd, gap = random.Random(5), dt.timedelta(minutes=30)
    rows = [(1 if rnd.random() < 0.4 else rnd.randrange(6), BASE + dt.timedelta(seconds=rnd.randrange(200_000))) for _ in range(500)]
    rows += [(7, BASE), (7, BASE + gap - dt.timedelta(microseconds=1)), (7, BASE + 3 * gap), (7, BASE + 3 * gap), (None, BASE), (1, None)]
    want, by_user = [], {}
    for user, ts in sorted((r for r in rows if r[1]), key=lambda r: (str(r[0]), r[1])):
        mine = by_user.setdefault(user, [])
        if mine and ts - mine[-1][1] <= gap:
            mine[-1][1:] = [ts, mine[-1][2] + 1]
        else:
            mine.append([ts, ts, 1])
    want = sorted(str((u, *s)) for u, found in by_user.items() for s in found)
    df = spark.createDataFrame(rows, "user_id long, ts timestamp_ntz")
    assert sorted(str(tuple(r)) for r in sessions(df, gap).collect()) == want
    assert sessions(df.filter("false"), gap).count() == 0
    edge = spark.createDataFrame([(1, BASE), (1, BASE + gap), (1, BASE + 2 * gap + dt.timedelta(microseconds=1))], df.schema)
    assert sorted(r["n_messages"] for r in sessions(edge, gap).collect()) == [1, 2]

    rnd.shuffle(rows)
    ahead = spark.createDataFrame(rows, df.schema).withColumn("at", F.monotonically_increasing_id())
    stream = feed(spark, ahead, ["at"], 4).drop("at")
    late = jobs.session_stream(stream, fresh_path(spark, "sessions"), gap, dt.timedelta(days=5))
    assert late.count() == 0  # the watermark has closed none
    closing = ahead.unionByName(spark.createDataFrame([(99, BASE + dt.timedelta(days=9), 1 << 60)], ahead.schema))
    stream = feed(spark, closing, ["at"], 4).drop("at")
    got = jobs.session_stream(stream, fresh_path(spark, "sessions"), gap, dt.timedelta(days=5)).collect()
    assert sorted(str(tuple(r)) for r in got) == want
