"""Bulk signals over an archive: importance, subject patterns, sender profiles, origin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivolt.functions import text as X
from archivolt.operators.cases import middles

# Points, thresholds and levels of importance.
POINTS = {
    "person": 20,
    "direct": 20,
    "copied": 5,
    "replied_often": 25,
    "replied": 15,
    "in_thread": 15,
    "question": 20,
    "answered": 0,
    "deadline": 10,
    "vip": 50,
    "filed_noise": -60,
    "list": -40,
    "automated": -30,
    "meeting_reply": -20,
}
NOISE = ("filed_noise", "list", "automated", "meeting_reply")
HIGH, MEDIUM, LOW = 70, 45, 10
OFTEN, BROADCAST, SMALL_CHAT = 5, 10, 5
NOISE_VALUES = ("newsletter", "notification", "alert", "backup", "newsletters")


def _domain(address: str = "from_address") -> Column:
    return F.lower(F.split_part(address, F.lit("@"), F.lit(2)))


def importance(messages: DataFrame, participants: DataFrame, effective: DataFrame, *, owner: str, vips: list[str], now: str, text: str = "subject") -> DataFrame:
    """(id, score, level, signals, waiting): incoming messages by summed signals, the owner's own score 0 and are low.

    ``text`` names the column that questions and deadlines are read in.  ``effective``: (message_id, dimension, value).  Feature tables are grouped
    once each and joined by equality, so the messages are never crossed.
    """
    sent = messages.where("direction = 'out'")
    since = F.lit(now).cast("timestamp") - F.expr("interval 2 years")
    people = participants.where(F.col("role").isin("to", "cc", "bcc"))
    recent = sent.where(F.col("received_at").cast("timestamp") >= since).select(F.col("id").alias("message_id"))
    contact = people.join(recent, "message_id").groupBy(F.lower("address").alias("sender")).agg(F.count_distinct("message_id").alias("contact_n"))
    thread_out = sent.where("thread_id is not null").groupBy("thread_id").agg(F.max("received_at").alias("last_out"))
    mine = F.lower("address") == owner
    recipients = people.groupBy(F.col("message_id").alias("id")).agg(
        F.bool_or(mine & (F.col("role") == "to")).alias("to_me"),
        F.bool_or(mine & (F.col("role") != "to")).alias("cc_me"),
        F.count_if(F.col("role") == "to").alias("n_to"),
        F.count_if(F.col("role").isin("to", "cc")).alias("n_rcpt"),
    )
    filed = F.when(F.col("dimension").isin("type", "topic") & F.lower("value").isin(*NOISE_VALUES), F.col("value"))
    marks = effective.groupBy(F.col("message_id").alias("id")).agg(F.max(filed).alias("noise_value"), F.max(F.when(F.col("dimension") == "importance", F.col("value"))).alias("marked"))
    # what texts say is read before the joins, so none is dealt out; both joins by id come together, so rows are dealt out by it once
    said = {"__asks": X.asks(F.col(text)), "__due": X.names_deadline(F.col(text), F.col("received_at")), "__meeting": X.meeting_reply(F.col("subject"))}
    said = {name: F.when(F.col("direction") == "in", c) for name, c in said.items()}  # no other message's are asked for
    rows = messages.withColumns({"sender": F.lower("from_address"), **said}).join(recipients, "id", "left").join(marks, "id", "left").join(contact, "sender", "left").join(thread_out, "thread_id", "left")

    yes = lambda c: F.coalesce(c, F.lit(False))
    listed = F.col("list_id").isNotNull() | (F.coalesce("list_unsubscribe", F.lit("")) != "")
    local = F.split_part("sender", F.lit("@"), F.lit(1))
    person = ~F.col("is_automated") & F.col("from_address").isNotNull() & ~F.coalesce(F.rlike(local, F.lit(X.NO_REPLY)), F.lit(False))
    email, to_me = F.col("medium") == "email", yes(F.col("to_me"))
    direct = F.when(F.col("medium") == "teams_chat", to_me & (F.coalesce("n_to", F.lit(0)) <= SMALL_CHAT)).otherwise(email & to_me & ~listed & (F.coalesce("n_rcpt", F.lit(0)) <= BROADCAST))
    contacts = F.coalesce("contact_n", F.lit(0))
    asks = person & direct & ~F.col("__meeting") & F.col("__asks")
    answered = yes(F.col("last_out") > F.col("received_at"))
    fires = {
        "person": person,
        "direct": direct,
        "copied": ~direct & ~listed & (yes(F.col("cc_me")) | to_me),
        "replied_often": contacts >= OFTEN,
        "replied": contacts.between(1, OFTEN - 1),
        "in_thread": F.col("last_out").isNotNull() & (F.col("medium") != "teams_chat"),
        "question": asks & ~answered,
        "answered": asks & answered,
        "deadline": F.col("__due"),
        "vip": yes(F.col("sender").isin(vips) | _domain().isin(vips)),
        "filed_noise": F.col("noise_value").isNotNull(),
        "list": listed,
        "automated": F.col("is_automated"),
        "meeting_reply": F.col("__meeting"),
    }
    fired = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(k).alias("signal"), F.lit(POINTS[k]).alias("points"))) for k, c in fires.items()]))
    incoming = F.col("direction") == "in"
    scored = rows.withColumn("reasons", F.when(incoming, fired).otherwise(F.array().cast("array<struct<signal:string,points:int>>")))
    score = F.aggregate("reasons", F.lit(0), lambda n, r: n + r["points"])
    noisy = F.exists("reasons", lambda r: r["signal"].isin(*NOISE))
    scored = scored.withColumn("score", score).withColumn("noisy", noisy)
    by_score = F.when(F.col("score") >= HIGH, "high").when(F.col("score") >= MEDIUM, "medium").when(F.col("score") >= LOW, "low").otherwise("noise")
    level = (
        F.when(F.col("marked") == "important", "high")
        .when(F.col("marked") == "not_important", "noise")
        .when(~incoming, "low")
        .when(F.col("noisy"), F.when(F.col("score") >= LOW, "low").otherwise("noise"))
        .otherwise(by_score)
    )
    waiting = F.exists("reasons", lambda r: r["signal"] == "question")
    return scored.select("id", "score", level.alias("level"), F.array_join(F.transform("reasons", lambda r: r["signal"]), ",").alias("signals"), waiting.alias("waiting"))


def patterns(messages: DataFrame) -> DataFrame:
    """(pattern_key, skeleton, messages, threads, accounts, samples): e-mail by subject template.

    ``samples`` are the first, middle and last message in time.
    """
    rows = messages.where("medium = 'email'").withColumn("skeleton", X.skeleton(F.col("subject"))).withColumn("pattern_key", X.pattern_key(F.col("from_address"), F.col("subject")))
    at = F.struct(F.col("received_at").isNull().alias("late"), "received_at", "id")
    made = rows.groupBy("pattern_key", "skeleton").agg(
        F.count("*").alias("messages"),
        F.count_distinct("thread_id").alias("threads"),
        F.sort_array(F.collect_set("account")).alias("accounts"),
        F.min_by("id", at).alias("first"),
        F.max_by("id", at).alias("last"),
    )
    held = made.join(middles(rows, "pattern_key", late=True).withColumnRenamed("id", "middle"), "pattern_key")
    samples = F.array_distinct(F.array("first", "middle", "last"))
    return held.select("pattern_key", "skeleton", "messages", "threads", "accounts", samples.alias("samples"))


def profiles(messages: DataFrame, participants: DataFrame) -> DataFrame:
    """A row per (account, sender) of incoming messages with counts and shares."""
    sent = messages.where("direction = 'out'").select(F.col("id").alias("message_id"), "account")
    to = participants.where(F.col("role").isin("to", "cc", "bcc")).join(sent, "message_id").groupBy("account", "address").agg(F.count_distinct("message_id").alias("written_to"))
    all_to = to.groupBy("address").agg(F.sum("written_to").alias("written_to_all"))
    answered = messages.where("direction = 'out' and thread_id is not null").select("thread_id").distinct().withColumn("__replied", F.lit(True))
    rows = messages.where("direction = 'in' and from_address is not null").withColumnRenamed("from_address", "address").join(answered, "thread_id", "left")
    made = rows.groupBy("account", "address").agg(
        F.count("*").alias("messages"),
        F.count_distinct("thread_id").alias("threads"),
        F.count_distinct(F.when(F.col("__replied"), F.col("thread_id"))).alias("replied_threads"),
        F.avg((F.coalesce("list_unsubscribe", F.lit("")) != "").cast("int")).alias("unsubscribe_share"),
        F.avg(F.col("is_automated").cast("int")).alias("automated_share"),
        F.count_distinct(X.skeleton(F.col("subject"))).alias("templates"),
    )
    joined = made.join(to, ["account", "address"], "left").join(all_to, "address", "left")
    return joined.withColumn("written_to", F.coalesce("written_to", F.lit(0))).withColumn("written_to_all", F.coalesce("written_to_all", F.lit(0)))


def origin(messages: DataFrame, profile: DataFrame) -> DataFrame:
    """(id, machine, person, value): what signals say a message comes from; where both speak it stays undecided."""
    rows = messages.where("direction = 'in'").join(profile.select("account", F.col("address").alias("from_address"), "written_to_all", "replied_threads", "automated_share", "unsubscribe_share"), ["account", "from_address"], "left")
    email = F.col("medium") == "email"
    unsubscribe = F.coalesce("list_unsubscribe", F.lit("")) != ""
    bulk = F.lower(F.coalesce("precedence", F.lit(""))).isin("bulk", "junk")
    bounce = F.rlike(F.split_part(F.lower("from_address"), F.lit("@"), F.lit(1)), F.lit("^(mailer-daemon|postmaster)$"))
    auto = F.startswith(F.lower(F.coalesce("auto_submitted", F.lit(""))), F.lit("auto-replied")) | (F.trim(F.coalesce("return_path", F.lit(""))) == "<>")
    written = F.coalesce("written_to_all", F.lit(0))
    machine = (
        F.when(~email & F.col("is_automated"), "notification|teams_app")
        .when(email & unsubscribe & bulk & (written == 0), "marketing|bulk_mailer")
        .when(email & F.coalesce(bounce, F.lit(False)), "mail_system|bounce")
        .when(email & auto, "auto_reply|auto_reply")
    )
    clean = email & ~F.col("is_automated") & ~unsubscribe & F.col("list_id").isNull()
    shares = F.greatest(F.coalesce("automated_share", F.lit(1.0)), F.coalesce("unsubscribe_share", F.lit(1.0)))
    person = (
        F.when(~email & ~F.col("is_automated"), "person|teams_user")
        .when(email & ~unsubscribe & F.rlike("from_name", F.lit(r"^\p{Lu}\S+ \S+ via \S")), "person_via_system|via_name")
        .when(clean & (written >= 2) & (F.coalesce("replied_threads", F.lit(0)) >= 1) & (shares <= 0.1), "person|correspondent")
    )
    both = rows.select("id", machine.alias("machine"), person.alias("person"))
    return both.withColumn("value", F.when(F.col("machine").isNotNull() & F.col("person").isNotNull(), None).otherwise(F.coalesce("machine", "person")))
