"""Selections of messages: filters, places, facets, pages."""

from __future__ import annotations

from urllib.parse import parse_qs

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from archivolt.operators import values as V

#: Messages on a page at most.
MOST = 500
MANY_KEYS = ("accounts", "exclude_accounts", "exclude_senders", "exclude_domains")


def domain() -> Column:
    return F.split_part("from_address", F.lit("@"), F.lit(2))


def filters_from(query: str) -> dict:
    """A query string as a filter dictionary; repeated ``dim`` pairs add up."""
    given = parse_qs(query, keep_blank_values=False)
    out: dict = {}
    for key, found in given.items():
        if key == "dim":
            out["values"] = [tuple(x.split(":", 1)) for x in found if ":" in x]
        elif key in MANY_KEYS:
            out[key] = [v for x in found for v in x.split(",") if v]
        elif key in ("has_attachments", "automated"):
            out[key] = found[-1].lower() in ("1", "true", "yes")
        elif key in ("limit", "offset"):
            out[key] = max(0, int(found[-1]))
        else:
            out[key] = found[-1]
    return out


def predicate(filters: dict) -> Column:
    """The filters that a message row alone decides."""
    out = F.lit(True)
    for key in ("medium", "account", "list_id"):
        if filters.get(key):
            out = out & (F.col(key) == filters[key])
    if filters.get("accounts"):
        out = out & F.col("account").isin(filters["accounts"])
    for key, column in (("exclude_accounts", F.col("account")), ("exclude_senders", F.lower("from_address")), ("exclude_domains", domain())):
        if filters.get(key):
            out = out & ~F.coalesce(column, F.lit("")).isin(filters[key])
    if filters.get("direction"):
        out = out & F.col("direction").isin(filters["direction"], "self")
    if filters.get("domain"):
        out = out & (domain() == filters["domain"])
    if filters.get("sender"):
        out = out & (F.lower("from_address") == filters["sender"].lower())
    if filters.get("thread") is not None:
        out = out & (F.col("thread_id") == filters["thread"])
    if filters.get("has_attachments") is not None:
        out = out & (F.col("has_attachments") == filters["has_attachments"])
    if filters.get("q"):
        asked = F.lit(filters["q"].lower())
        out = out & (F.contains(F.lower("subject"), asked) | F.contains(F.lower("from_address"), asked))
    return out


def select_messages(messages: DataFrame, filters: dict, assignments: DataFrame | None = None) -> DataFrame:
    """The messages that pass; ``values`` pairs need the assignments."""
    found = messages.where(predicate(filters))
    if filters.get("values"):
        if assignments is None:
            raise ValueError("value filters need assignments")
        found = with_values(found, assignments, filters["values"])
    if filters.get("automated") is not None and assignments is not None:
        found = V.machine_made(found, assignments).where(F.col("machine") == filters["automated"]).drop("machine")
    return found


def with_values(messages: DataFrame, assignments: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Messages whose effective values hold every (dimension, value): the selection is ranked, not the archive."""
    named = assignments.where(F.col("dimension").isin([d for d, _ in pairs]))
    effective = V.effective_message_values(messages.select("id", "thread_id"), named)
    wanted = F.lit(False)
    for dimension, value in pairs:
        wanted = wanted | ((F.col("dimension") == dimension) & (F.col("value") == value))
    held = effective.where(wanted).groupBy("message_id").agg(F.count_distinct("dimension", "value").alias("n")).where(F.col("n") == len(set(pairs)))
    return messages.join(held.select(F.col("message_id").alias("id")), "id", "left_semi")


def important(messages: DataFrame, levels: DataFrame) -> DataFrame:
    """The messages whose level of importance (id, level) is high or medium."""
    return messages.join(levels.where(F.col("level").isin("high", "medium")).select("id"), "id", "left_semi")


def with_places(messages: DataFrame, locations: DataFrame, participants: DataFrame) -> DataFrame:
    """``messages`` with arrays of present folders and labels, and of recipients."""
    places = locations.where("present").groupBy("message_id").agg(F.collect_set(F.coalesce("folder_path", "folder")).alias("folders"), F.collect_set("label").alias("labels"))
    people = participants.where(F.col("role").isin("to", "cc", "bcc")).groupBy("message_id").agg(F.collect_set("address").alias("recipients"))
    return messages.join(places.withColumnRenamed("message_id", "id"), "id", "left").join(people.withColumnRenamed("message_id", "id"), "id", "left")


def removed_state(locations: DataFrame, bin_prefix: str) -> DataFrame:
    """(message_id, state): gone from everywhere, only in the bin, or here."""
    place = F.coalesce("folder_path", "folder")
    flags = locations.groupBy("message_id").agg(F.bool_or("present").alias("held"), F.bool_and(F.startswith(place, F.lit(bin_prefix)) | ~F.col("present")).alias("binned"))
    return flags.select("message_id", F.when(~F.col("held"), "gone").when(F.col("binned"), "deleted").otherwise("here").alias("state"))


def page(messages: DataFrame, *, rank: Column | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page by rank, newest first; ties by id."""
    order = [F.desc_nulls_last("received_at"), F.desc("id")]
    if rank is not None:
        order = [F.desc(rank), *order]
    return messages.orderBy(*order).offset(offset).limit(min(limit, MOST))


def after(messages: DataFrame, received_at: Column, id_: Column, *, limit: int = 50) -> DataFrame:
    """Keyset paging: the messages older than a place; a missing time comes last."""
    floor = F.lit("0001-01-01 00:00:00").cast("timestamp")
    key = F.struct(F.coalesce(F.col("received_at").cast("timestamp"), floor).alias("t"), F.col("id").alias("i"))
    place = F.struct(F.coalesce(received_at.cast("timestamp"), floor).alias("t"), id_.alias("i"))
    return messages.where(key < place).orderBy(F.desc(key)).limit(min(limit, MOST))


def facet(messages: DataFrame, key: Column, *, top: int = 12) -> DataFrame:
    """(value, n): the most frequent values; ties by value."""
    return messages.where(key.isNotNull()).groupBy(key.alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(top)


def value_facet(messages: DataFrame, assignments: DataFrame, dimension: str) -> DataFrame:
    """(value, n) of the effective values of a dimension over a selection."""
    effective = V.effective_message_values(messages.select("id", "thread_id"), assignments.where(F.col("dimension") == dimension))
    return effective.groupBy("value").agg(F.count("*").alias("n"))


def threads(messages: DataFrame, *, people: int = 6) -> DataFrame:
    """(thread_id, matched, latest, mine, people): a row per thread of a selection."""
    rows = messages.where("thread_id is not null")
    flat = rows.groupBy("thread_id").agg(F.count("*").alias("matched"), F.max("received_at").alias("latest"), F.bool_or(F.col("direction") != "in").alias("mine"))
    first = rows.where("from_address is not null").groupBy("thread_id", "from_address").agg(F.min(F.struct(F.col("received_at").isNull().alias("late"), "received_at", "id")).alias("at"))
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("thread_id").orderBy("at"))).where(F.col("rank") <= people)
    named = ranked.groupBy("thread_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "from_address"))), lambda x: x["from_address"]).alias("people"))
    return flat.join(named, "thread_id", "left")
