"""Clusters of machine mail: senders, shared ones split by system, with what became of their mail."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from archivolt.functions import text as X
from archivolt.operators.graph import written
from archivolt.operators.grouping import group_status
from archivolt.operators.structure import NOT_OLD

# Systems that a shared sender has at least, and the least share of its mail that tells one; days and counts of a state.
LEAST_SYSTEMS, LEAST_SHARE = 2, 0.2
DEAD_DAYS, RECENT_DAYS, LEAST = 365, 90, 20
GONE = "(no longer on the server)"
KEYS = ["account", "sender", "system"]


def with_system(rows: DataFrame) -> DataFrame:
    """``rows`` (account, sender, subject and others) with ``system``: null where a sender speaks for one alone.

    A sender of an account is shared if its subjects tell two systems or more by tags or
    status words, on a fifth of its mail at least.  The counts are made before the split, so a sender
    of any size is one row of them.
    """
    keyed = rows.withColumn("__key", X.system_key(F.col("subject"))).withColumn("__told", X.system_told(F.col("subject")))
    heads = keyed.groupBy("account", "sender", "__key", "__told").agg(F.count("*").alias("n"))
    totals = heads.groupBy("account", "sender").agg(F.count_distinct(F.when(F.col("__told"), F.col("__key"))).alias("told"), F.sum(F.when(F.col("__told"), F.col("n")).otherwise(0)).alias("telling"), F.sum("n").alias("n"))
    shared = totals.select("account", "sender", ((F.col("told") >= LEAST_SYSTEMS) & (F.col("telling") >= LEAST_SHARE * F.col("n"))).alias("__shared"))
    return keyed.join(shared, ["account", "sender"]).withColumn("system", F.when(F.col("__shared"), F.col("__key"))).drop("__key", "__told", "__shared")


def _counts(rows: DataFrame, keys: list[str], value: Column, into: str, top: int) -> DataFrame:
    """(keys, into): the ``top`` values with their counts, ties by value; counted before any group is gathered."""
    counted = rows.select(*keys, value.alias("v")).groupBy(*keys, "v").agg(F.count("*").alias("n"))
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "v"))).where(F.col("rank") <= top)
    best = F.array_sort(F.collect_list(F.struct("rank", "v", "n")))
    return ranked.groupBy(*keys).agg(best.alias("b")).select(*keys, F.transform("b", lambda x: F.struct(x["v"].alias("value"), x["n"].alias("n"))).alias(into))


def clusters(messages: DataFrame, *, now: str, least: int = LEAST) -> DataFrame:
    """A row per cluster of ``least`` messages or more.

    ``messages``: id, account, sender, name, subject, received_at, kind, type, target,
    olds (present places) and in_inbox (null where nothing is present).  A row
    has account, sender, system, name, n, first, last, recent, last_year, status, in_inbox, the most
    frequent kinds (4), types, places and targets (3 each), and the newest two
    different subjects, a missing one empty.
    Rows without a sender are in no cluster; ties go by name.
    """
    moment = F.lit(now).cast("timestamp")
    ago = lambda days: F.col("received_at").cast("timestamp") >= moment - F.make_dt_interval(days=F.lit(days))
    # the group's key as one column without nulls, for joins
    # written, as each of the counts below would work out the messages' places and targets again
    known = written(messages.where("sender is not null"), "machine")
    rows = with_system(known).withColumn("key", F.to_json(F.struct(*KEYS)))
    base = rows.groupBy("key", *KEYS).agg(
        F.count("*").alias("n"),
        F.min("received_at").alias("first"),
        F.max("received_at").alias("last"),
        F.count_if(ago(RECENT_DAYS)).alias("recent"),
        F.count_if(ago(DEAD_DAYS)).alias("last_year"),
        F.count_if(F.coalesce("in_inbox", F.lit(False))).alias("in_inbox"),
    )
    base = base.where(F.col("n") >= least)
    kept = rows.join(base.select("key"), "key", "left_semi")
    held = F.when(F.col("olds").isNull(), F.array(F.lit(GONE))).otherwise(F.filter("olds", lambda o: ~o.isin(*NOT_OLD)))
    tops = [
        _counts(kept, ["key"], F.coalesce("kind", F.lit("(none)")), "kinds", 4),
        _counts(kept, ["key"], F.coalesce("type", F.lit("(none)")), "types", 3),
        _counts(kept.select("key", F.explode(held).alias("o")), ["key"], F.col("o"), "places", 3),
        _counts(kept, ["key"], F.coalesce("target", F.lit("(not planned)")), "plan", 3),
        _counts(kept.where("name is not null"), ["key"], F.col("name"), "names", 1),
    ]
    # the newest message of every different subject, then the newest two of those
    order = F.struct(F.coalesce(F.col("received_at").cast("timestamp"), moment).alias("t"), "id")
    subjects = kept.groupBy("key", X.without_prefixes(F.col("subject")).alias("s")).agg(F.max_by(F.coalesce("subject", F.lit("")), order).alias("subject"), F.max(order).alias("at"))
    newest = subjects.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("at")))).where("rank <= 2")
    examples = newest.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("rank", "subject"))).alias("e")).select("key", F.transform("e", lambda x: x["subject"]).alias("examples"))
    full = reduce(lambda a, b: a.join(b, "key", "left"), [*tops, examples], base)
    return full.select(*KEYS, F.get("names", F.lit(0))["value"].alias("name"), "n", "first", "last", "recent", "last_year", group_status(F.col("last"), F.col("last_year"), now).alias("status"), "in_inbox", "kinds", "types", F.coalesce("places", F.array().cast("array<struct<value:string,n:bigint>>")).alias("places"), "plan", "examples")


def summary(found: DataFrame, places: DataFrame) -> DataFrame:
    """(account, dead_clusters, dead_messages, dead_in_inbox, inbox_now, inbox_after): what cleaning the dead clusters would take from each inbox.

    ``found``: ``clusters``; ``places``: account and in_inbox of all messages.
    """
    dead = F.col("status") == "dead"
    made = found.groupBy("account").agg(F.count_if(dead).alias("dead_clusters"), *[F.sum(F.when(dead, F.col(c)).otherwise(0)).alias(into) for c, into in (("n", "dead_messages"), ("in_inbox", "dead_in_inbox"))])
    inbox = places.groupBy("account").agg(F.count_if(F.coalesce("in_inbox", F.lit(False))).alias("inbox_now"))
    return made.join(inbox, "account", "left").withColumn("inbox_now", F.coalesce("inbox_now", F.lit(0))).withColumn("inbox_after", F.col("inbox_now") - F.col("dead_in_inbox"))
