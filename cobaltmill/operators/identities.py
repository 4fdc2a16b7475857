"""Users looked up or made by a log of requests, as if the requests came one after the other."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cobaltmill.operators.usage import normal_email
from cobaltmill.session import discard, materialise

#: The time at which a user of the given table got its chat and its e-mail: before every request.
EXISTING = -(1 << 63)


def _keyed(df: DataFrame) -> DataFrame:
    """Adds one key per chat and per e-mail; requests without one get a key of their own and don't meet on one."""
    none = F.concat(F.lit("none:"), F.col("request_id").cast("string"))
    return df.withColumns({
        "chat_key": F.coalesce(F.concat(F.lit("chat:"), F.col("chat_id").cast("string")), none),
        "email_key": F.coalesce(F.concat(F.lit("mail:"), F.col("email")), none)})


def _known(users: DataFrame, requests: DataFrame, column: str, other: str, prefix: str) -> DataFrame:
    """Chats (or e-mails) of users, and those that requests bring alone: since when, whose, and whether paired.

    Of several users with one chat or e-mail the least key holds it.
    """
    given = users.filter(F.col(column).isNotNull()).select(
        F.col(column), F.lit(EXISTING).cast("long").alias("at"), "user_key", F.col(other).isNotNull().alias("paired"))
    alone = requests.filter(F.col(column).isNotNull() & F.col(other).isNull()).select(
        F.col(column), F.col("request_id").cast("long").alias("at"),
        F.concat(F.lit(prefix), F.col(column).cast("string")).alias("user_key"), F.lit(False).alias("paired"))
    first = given.unionByName(alone).groupBy(column).agg(F.min(F.struct("at", "user_key", "paired")).alias("k"))
    return materialise(first.select(F.concat(F.lit(prefix), F.col(column).cast("string")).alias("key"), "k.*"), "known")


def _ends(open_: DataFrame, *values: Column) -> DataFrame:
    """A row for each end of a request: its key, and a struct of values that differ between the ends."""
    return open_.select("request_id", "taken", F.explode(F.array(*values)).alias("end")).select(
        "request_id", "taken", "end.*")


def _judge(open_: DataFrame) -> DataFrame:
    """One round: what becomes of open requests by the first ones of their keys.

    A request pairs its keys if it is the first of both. A key is certainly paired by the time of its first
    request that is the first of its other key: that one pairs it unless an earlier one did. So all later
    requests of the key are out. A request with a single earlier one waits for just that one.
    """
    chat, email = F.col("chat_key"), F.col("email_key")
    firsts = materialise(_ends(open_, F.struct(chat.alias("key")), F.struct(email.alias("key"))).groupBy("key").agg(
        F.min("request_id").alias("first")), "firsts")
    marked = open_.join(firsts.toDF("chat_key", "chat_first"), "chat_key").join(
        firsts.toDF("email_key", "email_first"), "email_key")
    request = F.col("request_id")
    ends = _ends(
        marked,
        F.struct(chat.alias("key"), F.col("chat_first").alias("first"), (request == F.col("email_first")).alias("sure")),
        F.struct(email.alias("key"), F.col("email_first").alias("first"), (request == F.col("chat_first")).alias("sure")))
    limits = materialise(ends.groupBy("key").agg(
        F.min(F.when(F.col("sure"), request)).alias("until"), F.min(F.when(F.col("taken"), request)).alias("pair"),
        F.min(F.when(request > F.col("first"), request)).alias("second")), "limits")
    judged = marked
    for side in ("chat", "email"):
        judged = judged.join(limits.toDF(*[f"{side}_{c}" for c in limits.columns]), f"{side}_key")
    is_in = F.col("taken") | ((request == F.col("chat_first")) & (request == F.col("email_first")))
    is_out = reduce(Column.__or__, [
        F.coalesce((request > F.col(f"{s}_until")) | (request != F.col(f"{s}_pair")), request > F.col(f"{s}_until"),
                   request != F.col(f"{s}_pair"), F.lit(False)) for s in ("chat", "email")])
    only = F.when((request == F.col("chat_first")) & (request == F.col("email_second")), F.col("email_first")).when(
        (request == F.col("email_first")) & (request == F.col("chat_second")), F.col("chat_first"))
    stored = materialise(judged.select(
        "request_id", "chat_key", "email_key", F.when(is_in, True).when(is_out, False).alias("pairs"),
        F.coalesce("waits", only).alias("waits"), F.coalesce("flip", F.lit(True)).alias("flip")), "judged")
    discard(firsts)
    discard(limits)
    return stored


def ordered_pairs(edges: DataFrame) -> DataFrame:
    """Of requests (request_id, chat_key, email_key), taken in order, those that pair two keys still free.

    A request that waits for a single earlier one pairs exactly if that one does not. Such links are
    followed by pointer jumping: each round doubles their length, so a chain of n requests takes about log2 n
    rounds. A request that waits for several becomes one of these as earlier requests are settled; only
    logs in which each step depends on several undecided requests take a round per step. Stored.
    """
    state = "request_id, chat_key, email_key, cast(null as long) as waits, true as flip, false as taken".split(", ")
    open_ = stored = materialise(edges.selectExpr(*state), "open")
    settled: list[DataFrame] = []
    while not open_.isEmpty():
        judged = _judge(open_)
        if not settled:
            discard(stored)
        links = judged.select(F.col("request_id").alias("waits"), F.col("pairs").alias("t_pairs"),
                              F.col("waits").alias("t_waits"), F.col("flip").alias("t_flip"))
        for table in settled:
            links = links.unionByName(table.filter("pairs is not null").select(
                F.col("request_id").alias("waits"), F.col("pairs").alias("t_pairs"),
                F.lit(None).cast("long").alias("t_waits"), F.lit(True).alias("t_flip")))
        jumped = judged.filter("pairs is null and waits is not null").join(links, "waits", "left")
        told = F.col("t_pairs") != F.col("flip")
        moved = jumped.select(
            "request_id", "chat_key", "email_key", F.when(told, F.lit(None)).when(~told, F.lit(False)).alias("pairs"),
            F.coalesce("t_waits", "waits").alias("waits"),
            F.when(F.col("t_waits").isNull(), F.col("flip")).otherwise(F.col("flip") != F.col("t_flip")).alias("flip"),
            F.coalesce(told, F.lit(False)).alias("taken"))
        rest = judged.filter("pairs is not null or waits is null").withColumn("taken", F.lit(False))
        after = materialise(rest.unionByName(moved), "open")
        discard(judged)
        settled.append(after)
        open_ = after.filter("pairs is null").drop("pairs")
    pairs = [table.filter("pairs").select("request_id", "chat_key", "email_key") for table in settled]
    empty = edges.select("request_id", "chat_key", "email_key").limit(0)
    done = materialise(reduce(DataFrame.unionByName, pairs, empty), "pairs")
    for table in settled or [stored]:
        discard(table)
    return done


def get_or_create(users: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Resolve requests (request_id, chat_id, email) in order of their unique ids against users (user_id, chat_id, email).

    A request finds its user by chat id, else by e-mail (a user without chat id adopts it), else a user
    is created. The found user also takes the e-mail if it has none and nobody owns it. Users made by a
    batch take part like the others. Returns one resolution per request and the resulting users; a
    request with neither chat nor e-mail is rejected.

    Chats and e-mails are paired for good, by the first request that brings both while both are unpaired and
    not both known alone. When a key is first known alone is an aggregate; repeated pairs count once, by their first
    request; what is left is :func:`ordered_pairs`.
    """
    users = users.withColumn("email", normal_email(F.col("email"))).withColumn(
        "user_key", F.col("user_id").cast("string"))
    requests = materialise(
        requests.select("request_id", "chat_id", normal_email(F.col("email")).alias("email")), "requests")
    chats = _known(users, requests, "chat_id", "email", "chat:")
    emails = _known(users, requests, "email", "chat_id", "mail:")

    def of(table: DataFrame, side: str) -> DataFrame:
        return table.toDF(*[f"{side}_{c}" for c in table.columns])

    both = requests.filter("chat_id is not null and email is not null")
    both = _keyed(both).groupBy("chat_key", "email_key").agg(F.min("request_id").cast("long").alias("request_id"))
    seen = both.join(of(chats, "chat"), "chat_key", "left").join(of(emails, "email"), "email_key", "left")
    apart = (F.col("chat_at") < F.col("request_id")) & (F.col("email_at") < F.col("request_id"))
    free = ~(F.coalesce("chat_paired", F.lit(False)) | F.coalesce("email_paired", F.lit(False))
             | F.coalesce(apart, F.lit(False)))
    pairs = ordered_pairs(seen.filter(free))

    owned = pairs.join(of(chats, "chat"), "chat_key", "left").join(of(emails, "email"), "email_key", "left")
    before = {s: F.coalesce(F.col(f"{s}_at") < F.col("request_id"), F.lit(False)) for s in ("chat", "email")}
    owner = F.when(before["chat"], F.col("chat_user_key")).when(before["email"], F.col("email_user_key")).otherwise(
        F.col("chat_key"))
    owned = materialise(owned.select("request_id", "chat_key", "email_key", owner.alias("user_key")), "owned")

    def holders(known: DataFrame, side: str) -> DataFrame:
        """Who holds each chat or e-mail, and since when."""
        new = owned.select(F.col(f"{side}_key").alias("key"), F.col("request_id").alias("at"), "user_key")
        every = known.select("key", "at", "user_key").unionByName(new)
        return materialise(every.groupBy("key").agg(F.min(F.struct("at", "user_key")).alias("h")).select(
            F.col("key").alias(f"{side}_key"), F.col("h.at").alias(f"{side}_at"),
            F.col("h.user_key").alias(f"{side}_user")), "holders")

    chat_of, email_of = holders(chats, "chat"), holders(emails, "email")
    final = _keyed(requests).join(chat_of, "chat_key", "left").join(email_of, "email_key", "left")
    by_chat, by_email = F.col("chat_at") < F.col("request_id"), F.col("email_at") < F.col("request_id")
    is_new = F.coalesce(F.col("chat_at") == F.col("request_id"), F.lit(False)) | F.coalesce(
        F.col("email_at") == F.col("request_id"), F.lit(False))
    made = F.when(F.col("chat_id").isNull(), F.col("email_key")).otherwise(F.col("chat_key"))
    resolution = F.when(by_chat, "chat").when(by_email, "email").when(is_new, "created").otherwise("rejected")
    key = F.when(by_chat, F.col("chat_user")).when(by_email, F.col("email_user")).when(is_new, made)
    resolved = final.select("request_id", "chat_id", "email", resolution.alias("resolution"), key.alias("user_key"))

    holds = [
        users.select("user_key", F.lit(None).cast("string").alias("chat_key"), F.lit(None).cast("string").alias("email_key")),
        chat_of.select(F.col("chat_user").alias("user_key"), "chat_key", F.lit(None).cast("string").alias("email_key")),
        email_of.select(F.col("email_user").alias("user_key"), F.lit(None).cast("string").alias("chat_key"), "email_key")]
    after = reduce(DataFrame.unionByName, holds).groupBy("user_key").agg(
        F.min("chat_key").alias("chat_key"), F.min("email_key").alias("email_key"))
    chat_type = requests.schema["chat_id"].dataType
    return resolved, after.select(
        "user_key", F.substring("chat_key", 6, 1 << 30).cast(chat_type).alias("chat_id"),
        F.substring("email_key", 6, 1 << 30).alias("email"))
