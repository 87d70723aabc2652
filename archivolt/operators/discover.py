"""What an archive may hold unnoticed: questions left, renewals ahead, correspondents without a binder, senders gone quiet, new people."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Domains of private mail, words of renewals, and the bounds of the five lists.
CONSUMER = ("gmail.com", "googlemail.com", "hotmail.com", "hotmail.se", "outlook.com", "live.com", "live.se", "icloud.com", "me.com", "mac.com", "yahoo.com", "msn.com", "protonmail.com", "proton.me")
RENEWALS = r"(renew|förny|expir|utgår|förfaller|går ut|up for renewal|licen[sc]|avtalet)"
RENEWAL_YEARS, MOST_MONTHS, LEAST_YEARS, MONTHS_AHEAD = 6, 6, 2, 3
LEAST_THREADS, SHORTEST_NAME = 3, 3
QUIET_FROM, QUIET_TO, LOOKED_AT, LEAST_MAILS, PAUSES, NEWEST, MARKETING = 10, 180, 545, 12, 4, 40, 0.4
MARKETING_KINDS = ("offer", "announcement", "spam")
NEW_DAYS, WAITING_DAYS = 45, 60


def _domain(address: str) -> Column:
    return F.split_part(address, F.lit("@"), F.lit(2))


def _ago(now: str, days: int) -> Column:
    return F.lit(now).cast("timestamp") - F.make_dt_interval(days=F.lit(days))


def _at(name: str = "received_at") -> Column:
    return F.col(name).cast("timestamp")


def waiting(messages: DataFrame, asking: DataFrame, *, now: str) -> DataFrame:
    """(thread_id, id, days): conversations whose latest question, of the last two months, has no later answer; ``asking`` has the ids of questions."""
    asked = messages.join(asking.select("id"), "id", "left_semi").where((F.col("direction") == "in") & F.col("thread_id").isNotNull() & (_at() > _ago(now, WAITING_DAYS)))
    last = asked.groupBy("thread_id").agg(F.max(F.struct("received_at", "id")).alias("q")).select("thread_id", "q.*")
    sent = messages.where("direction = 'out' and thread_id is not null").groupBy("thread_id").agg(F.max("received_at").alias("answered"))
    left = last.join(sent, "thread_id", "left").where(F.col("answered").isNull() | (F.col("answered") <= F.col("received_at")))
    return left.select("thread_id", "id", (F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(_at())).alias("seconds"))


def renewals(messages: DataFrame, own: list[str], *, now: str) -> DataFrame:
    """(domain, month, years, n, last_year, until, example): mails of renewal that come in the same month of several years, due within three months.

    A domain that writes such mails in more than six months of the year sends reports, not renewals.
    """
    said = messages.where((F.col("direction") == "in") & F.rlike("subject", F.lit("(?iU)" + RENEWALS)) & (_at() > F.lit(now).cast("timestamp") - F.make_ym_interval(years=F.lit(RENEWAL_YEARS))))
    rows = said.select(_domain("from_address").alias("domain"), F.month("received_at").alias("month"), F.year("received_at").alias("year"), "subject", "id").where(F.col("domain").isNotNull() & ~F.col("domain").isin(own))
    by = rows.groupBy("domain", "month").agg(F.count_distinct("year").alias("years"), F.count("*").alias("n"), F.max("year").alias("last_year"), F.max_by("subject", F.struct("year", "id")).alias("example"))
    spread = by.groupBy("domain").agg(F.count("*").alias("months"))
    until = F.pmod(F.col("month") - F.month(F.lit(now).cast("timestamp")), F.lit(12))
    kept = by.where(F.col("years") >= LEAST_YEARS).join(spread.where(F.col("months") <= MOST_MONTHS).select("domain"), "domain", "left_semi")
    return kept.withColumn("until", until).where(F.col("until") <= MONTHS_AHEAD)


def without_binder(messages: DataFrame, participants: DataFrame, binders: DataFrame, own: list[str], *, now: str) -> DataFrame:
    """(domain, threads, people, last): organisations written to in three threads or more within a year that no binder's text names.

    A binder names a domain by a word that is the domain, or its name before the last dot.
    """
    sent = messages.where((F.col("direction") == "out") & (_at() > _ago(now, 365))).select(F.col("id").alias("message_id"), "thread_id", "received_at")
    to = participants.where(F.col("role").isin("to", "cc") & F.col("address").like("%@%.%")).select("message_id", "address", _domain("address").alias("domain"))
    made = to.where(~F.col("domain").isin([*CONSUMER, *own])).join(sent, "message_id").groupBy("domain")
    found = made.agg(F.count_distinct("thread_id").alias("threads"), F.count_distinct("address").alias("people"), F.max("received_at").alias("last")).where(F.col("threads") >= LEAST_THREADS)
    words = binders.select(F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}.-]+")).alias("word")).where("word <> ''").distinct()
    parts = F.split("domain", r"\.")
    name = F.when(F.size(parts) >= 2, F.element_at(parts, -2)).otherwise(F.col("domain"))
    named = found.select("domain", F.explode(F.array("domain", name)).alias("word")).where(F.length("word") >= SHORTEST_NAME).join(words, "word", "left_semi")
    return found.join(named.select("domain").distinct(), "domain", "left_anti")


def quiet_senders(messages: DataFrame, kinds: DataFrame, *, now: str) -> DataFrame:
    """(address, account, a_year, last): automated senders that wrote regularly and have paused four times as long as they used to.

    A sender whose newest mails are marketing by their kinds (message_id, value) was unsubscribed from, and is left out.
    """
    rows = messages.where("is_automated and direction = 'in' and from_address is not null")
    recent = rows.where(_at() > _ago(now, LOOKED_AT)).groupBy("from_address").agg(F.max("received_at").alias("last"), F.count("*").alias("n"), F.min("account").alias("account"))
    recent = recent.where((_at("last") >= _ago(now, QUIET_TO)) & (_at("last") <= _ago(now, QUIET_FROM)) & (F.col("n") >= LEAST_MAILS))
    within = messages.join(recent, "from_address").where((_at() <= _at("last")) & (_at() >= _at("last") - F.make_dt_interval(days=F.lit(365))))
    yearly = within.groupBy("from_address", F.col("last"), recent["account"].alias("account")).agg(F.count("*").alias("a_year")).where(F.col("a_year") >= LEAST_MAILS)
    pause = F.greatest(F.lit(QUIET_FROM), F.floor(PAUSES * 365.0 / F.col("a_year") + 0.5).cast("int"))
    silent = yearly.where(_at("last") < F.lit(now).cast("timestamp") - F.make_dt_interval(days=pause))
    newest = messages.join(silent.select("from_address"), "from_address", "left_semi").withColumn("rn", F.row_number().over(Window.partitionBy("from_address").orderBy(F.desc_nulls_last("received_at"), F.desc("id")))).where(F.col("rn") <= NEWEST)
    told = newest.join(kinds.select(F.col("message_id").alias("id"), "value"), "id").groupBy("from_address").agg(F.count_if(F.col("value").isin(*MARKETING_KINDS)).alias("mk"), F.count("*").alias("k"))
    marketing = told.where(F.col("mk") >= MARKETING * F.col("k")).select("from_address")
    return silent.join(marketing, "from_address", "left_anti").select(F.col("from_address").alias("address"), "account", "a_year", "last")


def new_people(messages: DataFrame, participants: DataFrame, *, now: str) -> DataFrame:
    """(address, name, first, n): persons who first wrote in the last 45 days, at least twice, and were written to."""
    rows = messages.where("direction = 'in' and not is_automated and from_address is not null")
    order = F.struct(F.col("received_at").isNotNull().alias("known"), "received_at", "id")
    made = rows.groupBy(F.col("from_address").alias("address")).agg(F.min("received_at").alias("first"), F.count("*").alias("n"), F.max_by(F.struct("from_name"), order)["from_name"].alias("name"))
    fresh = made.where((_at("first") > _ago(now, NEW_DAYS)) & (F.col("n") >= 2))
    written = participants.join(messages.where("direction = 'out'").select(F.col("id").alias("message_id")), "message_id", "left_semi").select("address").distinct()
    return fresh.join(written, "address", "left_semi").select("address", "name", "first", "n")
