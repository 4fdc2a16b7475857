"""Streaming forms of the quota, payment and token operators.

Each job runs with ``availableNow`` and can be started again on the same folder to continue. All
folders lie in the shared folder of the session.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from cobaltmill.functions import vocab
from cobaltmill.operators import payments, tokens, usage
from cobaltmill.operators.sessions import GAP
from cobaltmill.session import STATE_STORE, remove_path
from cobaltmill.streaming.strict import FOLDED, STATE, strict_folder

#: The buckets of references whose states a stream keeps together.
BUCKETS = 1 << 12
_STATE_KEY = "spark.sql.streaming.stateStore.providerClass"


def _run(writer, folder: str) -> StreamingQuery:
    spark = SparkSession.active()
    if spark.conf.get(_STATE_KEY, None) != STATE_STORE:
        spark.conf.set(_STATE_KEY, STATE_STORE)
    query = writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def daily_quota_stream(messages: DataFrame, since: DataFrame, folder: str,
                       limit: int = vocab.DAILY_LIMIT, zone: str = vocab.QUOTA_ZONE,
                       late_days: int | None = None) -> DataFrame:
    """Quota outcomes of a message stream; returns the outcomes written so far.

    Each micro-batch runs the batch operator with the counts of earlier batches, one small row per user
    and day, kept as a snapshot per batch id; a repeated batch rewrites the same files, and a snapshot
    goes once the one after the next is written. With ``late_days`` the counts of older days go too, and
    messages of such days are marked late; without it the stream gives what the batch operator gives for
    messages in order.
    """
    spark = messages.sparkSession
    used_schema = "user_id long, local_day date, admitted long"

    def snapshot(batch_id: int) -> DataFrame:
        if batch_id < 0:
            return spark.createDataFrame([], used_schema)
        return spark.read.schema(used_schema).parquet(f"{folder}/used/{batch_id}")

    def step(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # read twice below
        before = snapshot(batch_id - 1)
        result = usage.daily_quota(batch, since, limit, zone, before)
        if late_days is not None:
            horizon = F.date_sub(before.agg(F.max("local_day")).scalar(), late_days)
            late = (F.col("outcome") != "premium") & F.coalesce(F.col("local_day") < horizon, F.lit(False))
            result = result.withColumn("outcome", F.when(late, "late").otherwise(F.col("outcome")))
        target = f"{folder}/outcomes/{batch_id}"
        result.write.mode("overwrite").parquet(target)
        written = spark.read.parquet(target)
        now = written.filter(F.col("outcome") == "admitted").groupBy("user_id", "local_day").agg(
            F.count(F.lit(1)).alias("admitted")
        )
        total = before.unionByName(now).groupBy("user_id", "local_day").agg(
            F.sum("admitted").alias("admitted")
        )
        if late_days is not None:
            newest = F.greatest(
                before.agg(F.max("local_day")).scalar(), written.agg(F.max("local_day")).scalar()
            )
            total = total.filter(F.col("local_day") >= F.date_sub(newest, late_days))
        total.write.mode("overwrite").parquet(f"{folder}/used/{batch_id}")
        remove_path(spark, f"{folder}/used/{batch_id - 2}")
        batch.unpersist()

    _run(messages.writeStream.foreachBatch(step), folder)
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/outcomes")


def payment_fold_stream(events: DataFrame, folder: str) -> DataFrame:
    """Payment state per reference; returns the latest state of every reference.

    The fold is a set of combinable aggregates, so Spark's own streaming state holds one row per
    reference. Every micro-batch writes the references it changed.
    """
    spark = events.sparkSession

    def step(changed: DataFrame, batch_id: int) -> None:
        changed.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(
            f"{folder}/state/{batch_id}"
        )

    _run(payments.payment_fold(events).writeStream.outputMode("update").foreachBatch(step), folder)
    changes = spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/state")
    row = F.struct(*[c for c in changes.columns if c not in ("reference", "batch")])
    latest = changes.groupBy("reference").agg(F.max_by(row, "batch").alias("s"))
    return latest.select("reference", "s.*")


def strict_payment_stream(events: DataFrame, folder: str, lateness: dt.timedelta = dt.timedelta(days=1),
                          idle: dt.timedelta | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Strict payment state per reference (a later failure undoes a payment); the latest state of each.

    Events may come in any order within ``lateness`` of the newest; those behind it are ignored. The
    state of a reference is its fold up to the watermark and the events after it, which are folded in
    order once the watermark has passed them; every change writes the state that follows from both.
    With ``idle`` a reference without events for that long leaves the state, and what is written stays;
    a later event of it begins anew.

    References are dealt to ``buckets`` by a hash, and the states of a bucket are read and written together,
    so Python is called once for a bucket with new events. A bucket holds its share of all references: many
    references ask for more buckets. A folder keeps to the number it began with.

    The waiting events of one bucket, those of ``lateness`` and one micro-batch, are held by one task.
    """
    spark = events.sparkSession
    zone = events.schema["ts"].dataType
    timed = events.select(
        "reference", F.col("ts").cast("timestamp").alias("at"), "event_id",
        F.coalesce("is_success", F.lit(False)).alias("is_success"), F.col("amount").cast("long").alias("amount"),
        F.col("chat_id").cast("long").alias("chat_id"), F.nullif("payer_email", F.lit("")).alias("payer_email"))
    timed = timed.withWatermark("at", f"{lateness // dt.timedelta(milliseconds=1)} milliseconds")
    named = F.coalesce("reference", F.lit(""))
    keyed = timed.select(
        F.col("at"), F.pmod(F.xxhash64(named), F.lit(buckets)).alias("bucket"), named.alias("reference"), F.to_json(F.struct(
            F.unix_micros("at").alias("ts"), "event_id", "is_success", "amount", "chat_id", "payer_email")).alias("event"))
    folded = keyed.groupBy("bucket").applyInPandasWithState(
        strict_folder(None if idle is None else idle // dt.timedelta(milliseconds=1)), FOLDED, STATE, "update",
        GroupStateTimeout.EventTimeTimeout)

    def step(changed: DataFrame, batch_id: int) -> None:
        changed.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(
            f"{folder}/state/{batch_id}")

    _run(folded.writeStream.outputMode("update").foreachBatch(step), folder)
    schema = f"{FOLDED}, batch long"
    changes = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{folder}/state")
    row = F.struct(*[c for c in changes.columns if c not in ("reference", "batch")])
    latest = changes.groupBy("reference").agg(F.max_by(row, "batch").alias("s")).select("reference", "s.*")
    return latest.withColumn("paid_at", F.timestamp_micros("paid_at").cast(zone))


def session_stream(messages: DataFrame, folder: str, gap: dt.timedelta = GAP,
                   lateness: dt.timedelta = dt.timedelta(hours=1)) -> DataFrame:
    """Closed sessions of a message stream (user_id, ts), each written once.

    A session is closed when the watermark, ``lateness`` behind the newest message, has passed its end by
    more than ``gap``; until then late messages extend it or join two into one. Later ones are ignored.
    """
    def text(length: dt.timedelta) -> str:
        return f"{length // dt.timedelta(microseconds=1)} microseconds"

    kind = messages.schema["ts"].dataType
    timed = messages.select("user_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", text(lateness))
    found = timed.groupBy("user_id", F.session_window("ts", text(gap)).alias("w")).agg(
        F.min("ts").alias("session_start"), F.max("ts").alias("session_end"), F.count(F.lit(1)).alias("n_messages"))
    closed = found.drop("w")
    _run(closed.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/sessions"), folder)
    written = messages.sparkSession.read.schema(closed.schema).parquet(f"{folder}/sessions")
    return written.withColumns({c: F.col(c).cast(kind) for c in ("session_start", "session_end")})


def first_use_stream(uses: DataFrame, issues: DataFrame, folder: str, lateness: str | None = None) -> DataFrame:
    """First live use by time of each one-shot token; ``issues`` is a stored table.

    The state holds the smallest (used_at, use_id) per token and hour of use, and each micro-batch writes
    the ones that it lowered. With ``lateness`` (such as "30 minutes") hours behind the watermark leave the
    state and later uses of them are ignored; without it any use counts, however late it arrives.
    """
    spark = uses.sparkSession
    live = tokens.resolve_uses(uses if lateness is None else uses.withWatermark("used_at", lateness), issues)
    firsts = live.filter("is_live").groupBy("token", F.window("used_at", "1 hour").alias("hour")).agg(
        F.min(F.struct("used_at", "use_id")).alias("first")).select("token", "first")

    def step(changed: DataFrame, batch_id: int) -> None:
        changed.write.mode("overwrite").parquet(f"{folder}/firsts/{batch_id}")

    _run(firsts.writeStream.outputMode("update").foreachBatch(step), folder)
    written = spark.read.schema(firsts.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/firsts")
    return written.groupBy("token").agg(F.min("first").alias("first")).select("first.use_id", "token", "first.used_at")


def token_expiry_stream(issues: DataFrame, uses: DataFrame, folder: str) -> DataFrame:
    """Joins two streams within each token's life; unused tokens come out once they have expired.

    The time bound lets Spark drop both sides' state behind the watermark.
    """
    span = f"{vocab.TOKEN_MINUTES} minutes"
    left = tokens.with_expiry(issues).withWatermark("issued_at", "1 minute").alias("i")
    right = uses.withWatermark("used_at", "1 minute").withColumnRenamed("token", "use_token").alias("u")
    condition = (
        (F.col("token") == F.col("use_token"))
        & (F.col("used_at") >= F.col("issued_at"))
        & (F.col("used_at") <= F.col("issued_at") + F.expr(f"INTERVAL {span}"))
        & (F.col("used_at") <= F.col("expires_at"))
    )
    joined = left.join(right, condition, "leftOuter").select(
        "token", "issued_at", "expires_at", "use_id", "used_at"
    )
    _run(joined.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/joined"), folder)
    return issues.sparkSession.read.schema(joined.schema).parquet(f"{folder}/joined")
