"""Where messages come from, by all signals: eight of machines and five of persons, with what they read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivolt.functions import text as X
from archivolt.operators import signals
from archivolt.plans.conditions import java_regex

# Patterns of senders, subjects, programs and names, origins by type, and the bounds of lists and correspondents.
QUARANTINE = r"^(quarantine@messaging\.microsoft\.com|quarantine@[a-z0-9.-]+\.protection\.outlook\.com)$"
BOUNCE = (
    r"^\s*(undeliverable|olevererbart|delivery status notification|mail delivery (failed|failure|subsystem)"
    r"|returned mail|undelivered mail|delivery (has )?failed|delayed message|fördröjd leverans"
    r"|message delivery failure|non-?delivery|failure notice|kan inte levereras|levererades inte)"
)
MAILERS = (
    r"(mailchimp|getresponse|nlserver|sailthru|activecampaign|sendinblue|brevo|create ?send|"
    r"campaign ?monitor|carma|apsis|klaviyo|mailerlite|rule\.io|ungapped|hubspot|marketo|"
    r"exacttarget|emarsys|dotdigital|mailjet|substack|beehiiv|convertkit)"
)
TRANSACTIONS = (
    r"\m(kvitto|receipt|faktura|invoice|order|beställning|betalning|payment|bokning|booking|"
    r"biljett|ticket|leverans|delivery|paket|package|bekräftelse|confirmation|köp|purchase)"
)
VIA = r"""^\s*"?[[:upper:]][[:lower:]]+(\s+[[:upper:]][[:lower:]'’.-]*)+\s+\(?[vV]ia\s+\S"""
DAEMON = r"^(mailer-daemon|postmaster)$"
TYPES = {
    "alert": ("alert", "security_event", "alarm", "incident", "backup", "security"),
    "system_report": ("report",),
    "transactional": ("receipt", "invoice", "order", "booking", "shipping", "subscription", "statement", "payment", "sign_in", "password"),
    "marketing": ("newsletter", "promotion", "event_webinar", "survey"),
    "auto_reply": ("calendar_response",),
    "notification": ("notification",),
}
VERSIONS = {
    "quarantine": 1, "event": 2, "type": 2, "teams_app": 1, "bulk_mailer": 1, "mailing_list": 1, "bounce": 2, "auto_reply": 1,
    "teams_user": 1, "via_name": 1, "sender_header": 1, "thread_reply": 1, "correspondent": 1,
}
LIST_SENDERS, LIST_SHARE, WRITTEN, MACHINE_SHARE, TEMPLATE_THREADS = 3, 0.5, 2, 0.1, 3


def profiles(messages: DataFrame, participants: DataFrame, events: DataFrame) -> DataFrame:
    """``signals.profiles`` with first_at, last_at, last_written_at (over all accounts) and event_share.

    ``events``: message_id of messages that an event was read from.
    """
    told = events.select("message_id").distinct().withColumn("__event", F.lit(1))
    rows = messages.where("direction = 'in' and from_address is not null").join(told.withColumnRenamed("message_id", "id"), "id", "left")
    more = rows.groupBy("account", F.col("from_address").alias("address")).agg(F.min("received_at").alias("first_at"), F.max("received_at").alias("last_at"), F.avg(F.coalesce("__event", F.lit(0))).alias("event_share"))
    sent = messages.where("direction = 'out'").select(F.col("id").alias("message_id"), "received_at")
    written = participants.where(F.col("role").isin("to", "cc", "bcc")).join(sent, "message_id").groupBy("address").agg(F.max("received_at").alias("last_written_at"))
    return signals.profiles(messages, participants).join(more, ["account", "address"]).join(written, "address", "left")


def lists(messages: DataFrame) -> DataFrame:
    """(list_id, senders, top_share): how many send to a list, and the largest share of one."""
    each = messages.where("direction = 'in' and list_id is not null").groupBy("list_id", "from_address").agg(F.count("*").alias("n"))
    return each.groupBy("list_id").agg(F.count("*").alias("senders"), (F.max("n") / F.sum("n")).alias("top_share"))


def _like(text: Column, pattern: str) -> Column:
    return F.coalesce(F.rlike(text, F.lit(java_regex(pattern))), F.lit(False))


def _case(branches: list[tuple[Column, str, str]]) -> Column:
    """The first signal that holds, as value|signal@version."""
    out = F.lit(None).cast("string")
    for holds, value, signal in reversed(branches):
        out = F.when(holds, f"{value}|{signal}@{VERSIONS[signal]}").otherwise(out)
    return out


def features(messages: DataFrame, participants: DataFrame, events: DataFrame, types: DataFrame) -> DataFrame:
    """Incoming messages with all that the signals read; see ``origin``."""
    read = events.groupBy(F.col("message_id").alias("id")).agg(F.lit(True).alias("event"), F.bool_and((F.col("kind") == "backup") & (F.col("status") == "ok")).alias("report_only"))
    replied = messages.where("direction = 'out' and thread_id is not null").select("thread_id").distinct().withColumn("replied", F.lit(True))
    templates = messages.where("medium = 'email'").groupBy(X.pattern_key(F.col("from_address"), F.col("subject")).alias("__pattern")).agg(F.count_distinct("thread_id").alias("template_threads"))
    profile = profiles(messages, participants, events).select("account", F.col("address").alias("from_address"), "written_to_all", "replied_threads", "automated_share", "unsubscribe_share", "event_share")
    differs = participants.where("role = 'sender'").select(F.col("message_id").alias("id"), "address").join(messages.select("id", "from_address"), "id").where("address <> from_address").select("id").distinct().withColumn("sender_differs", F.lit(True))
    rows = messages.where("direction = 'in'").withColumn("__pattern", F.when(F.col("medium") == "email", X.pattern_key(F.col("from_address"), F.col("subject"))))
    for other, key in ((read, "id"), (types.select(F.col("message_id").alias("id"), F.col("value").alias("type")), "id"), (differs, "id"), (replied, "thread_id"), (templates, "__pattern"), (lists(messages), "list_id")):
        rows = rows.join(other, key, "left")
    return rows.join(profile, ["account", "from_address"], "left")


def origin(messages: DataFrame, participants: DataFrame, events: DataFrame, types: DataFrame, ruled: DataFrame) -> DataFrame:
    """(id, machine, person, value, signal, verdict) of every incoming message that no rule of the owner settles.

    ``messages``: the archive's columns, reasons (an array, what marks it as automated) and
    x_mailer; ``events``: message_id, kind, status; ``types``: message_id and its effective type;
    ``ruled``: ids whose origin a rule sets, which win and are left out.  Of each side
    the first signal that holds speaks; where both speak the message is in conflict and
    has no value; where none does it is undecided.
    """
    rows = features(messages, participants, events, types).join(ruled.select("id"), "id", "left_anti")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    email, subject = F.col("medium") == "email", text("subject")
    local = F.split_part(text("from_address"), F.lit("@"), F.lit(1))
    unsubscribe = text("list_unsubscribe") != ""
    bulk, mailer = F.lower(text("precedence")).isin("bulk", "junk"), _like(text("x_mailer"), MAILERS)
    reasons = F.coalesce("reasons", F.array().cast("array<string>"))
    auto = F.startswith(F.lower(text("auto_submitted")), F.lit("auto-replied")) | F.array_contains(reasons, "null-return-path") | _like(local, DAEMON)
    machine = [
        (email & F.rlike(F.lower(text("from_address")), F.lit(QUARANTINE)), "mail_system", "quarantine"),
        (yes("event") & yes("report_only"), "system_report", "event"),
        (yes("event"), "alert", "event"),
        *[(F.coalesce(F.col("type").isin(*types_of), F.lit(False)), value, "type") for value, types_of in TYPES.items()],
        (~email & yes("is_automated"), "notification", "teams_app"),
        (email & unsubscribe & (bulk | mailer) & (count("written_to_all") == 0) & ~_like(subject, TRANSACTIONS), "marketing", "bulk_mailer"),
        (
            email & F.col("list_id").isNotNull() & (count("senders") >= LIST_SENDERS) & (F.coalesce("top_share", F.lit(1.0)) <= LIST_SHARE) & ~F.array_contains(reasons, "noreply-sender") & ~bulk & ~mailer,
            "list",
            "mailing_list",
        ),
        (email & auto & (_like(local, DAEMON) | _like(subject, BOUNCE)), "mail_system", "bounce"),
        (email & auto, "auto_reply", "auto_reply"),
    ]
    clean = email & (F.size(reasons) == 0) & ~unsubscribe & F.col("list_id").isNull()
    one = lambda c: F.coalesce(F.col(c), F.lit(1.0))
    shares = F.greatest(one("automated_share"), one("unsubscribe_share"), one("event_share"))
    person = [
        (~email & ~yes("is_automated"), "person", "teams_user"),
        (email & ~unsubscribe & F.rlike(text("from_name"), F.lit(java_regex(VIA).replace("(?iU)", "(?U)", 1))), "person_via_system", "via_name"),
        (clean & yes("sender_differs") & (count("written_to_all") > 0), "person_via_system", "sender_header"),
        (clean & (count("written_to_all") > 0) & yes("replied"), "person", "thread_reply"),
        (clean & (count("written_to_all") >= WRITTEN) & (count("replied_threads") >= 1) & (shares <= MACHINE_SHARE) & (count("template_threads") < TEMPLATE_THREADS), "person", "correspondent"),
    ]
    both = rows.select("id", _case(machine).alias("machine"), _case(person).alias("person"))
    conflict = F.col("machine").isNotNull() & F.col("person").isNotNull()
    pick = F.when(~conflict, F.coalesce("machine", "person"))
    told = both.withColumn("__pick", pick).withColumn("verdict", F.when(conflict, "conflict").when(F.col("__pick").isNull(), "undecided").otherwise("decided"))
    return told.select("id", "machine", "person", F.split_part("__pick", F.lit("|"), F.lit(1)).alias("value"), F.split_part("__pick", F.lit("|"), F.lit(2)).alias("signal"), "verdict")
