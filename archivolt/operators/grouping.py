"""Sessions, sender groups, clusters and intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The gap that ends a conversation window, and the messages in one part of it.
GAP_HOURS, PART = 2, 30
#: After so many days without mail a group is dead; under so many a year it is quiet.
DEAD_DAYS, QUIET_PER_YEAR = 365, 12


def sessions(rows: DataFrame, keys: list[str], at: str, order: list[str], gap_seconds: int = GAP_HOURS * 3600, part: int = PART) -> DataFrame:
    """``rows`` with ``session`` (from 1 within the keys) and ``part`` (from 0 within the session).

    A session ends where the next row is more than the gap away; a gap of exactly
    that length doesn't end it.  Rows without a time are left out.
    """
    window = Window.partitionBy(*keys).orderBy(at, *order)
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    starts = F.coalesce((micros - F.lag(micros).over(window)) > gap_seconds * 1_000_000, F.lit(True))
    numbered = rows.where(F.col(at).isNotNull()).withColumn("__start", starts.cast("int"))
    numbered = numbered.withColumn("session", F.sum("__start").over(window.rowsBetween(Window.unboundedPreceding, 0))).drop("__start")
    within = Window.partitionBy(*keys, "session").orderBy(at, *order)
    return numbered.withColumn("part", F.floor((F.row_number().over(within) - 1) / part).cast("long"))


def group_status(last: Column, last_year: Column, now: str) -> Column:
    """dead, quiet or active."""
    edge = F.lit(now).cast("timestamp") - F.make_dt_interval(days=F.lit(DEAD_DAYS))
    return F.when(last.isNull() | (last.cast("timestamp") < edge), "dead").when(last_year < QUIET_PER_YEAR, "quiet").otherwise("active")


def clusters(rows: DataFrame, keys: list[str], at: str, now: str) -> DataFrame:
    """(keys, n, last_year, status): groups of machine mail with their state."""
    year = F.lit(now).cast("timestamp") - F.make_dt_interval(days=F.lit(DEAD_DAYS))
    counted = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.max(at).alias("last"), F.count_if(F.col(at).cast("timestamp") >= year).alias("last_year"))
    return counted.withColumn("status", group_status(F.col("last"), F.col("last_year"), now))


def top_values(rows: DataFrame, keys: list[str], value: str, n: int) -> DataFrame:
    """(keys, value, count, rank): the n most frequent values of each group; ties by value."""
    counted = rows.groupBy(*keys, value).agg(F.count("*").alias("count"))
    order = Window.partitionBy(*keys).orderBy(F.desc("count"), value)
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def split_senders(rows: DataFrame, sender: str, head: str, tagged: Column, *, least_heads: int = 2, least_share: float = 0.2) -> DataFrame:
    """(sender, head, n): senders that speak for several systems are split by head, others stay whole (null head)."""
    totals = rows.groupBy(sender).agg(F.count_distinct(F.when(tagged, F.col(head))).alias("__heads"), F.avg(tagged.cast("int")).alias("__share"))
    shared = (F.col("__heads") >= least_heads) & (F.col("__share") >= least_share)
    flagged = rows.join(totals.select(sender, shared.alias("__split")), sender)
    return flagged.groupBy(sender, F.when(F.col("__split"), F.col(head)).alias(head)).agg(F.count("*").alias("n"))


def busy_seconds(rows: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """(keys, seconds): time covered by intervals, overlaps counted once."""
    window = Window.partitionBy(*keys).orderBy(start, end)
    low, high = F.unix_micros(F.col(start).cast("timestamp")), F.unix_micros(F.col(end).cast("timestamp"))
    before = F.max(high).over(window.rowsBetween(Window.unboundedPreceding, -1))
    gained = F.greatest(F.lit(0), high - F.greatest(low, F.coalesce(before, low)))
    return rows.where(F.col(end) > F.col(start)).withColumn("__gained", gained).groupBy(*keys).agg((F.sum("__gained") / 1_000_000).alias("seconds"))


def sliding_counts(rows: DataFrame, keys: list[str], at: str, seconds: int) -> DataFrame:
    """``rows`` with ``recent``: rows of the same keys within the last ``seconds``, itself included."""
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    frame = Window.partitionBy(*keys).orderBy(micros).rangeBetween(-seconds * 1_000_000, 0)
    return rows.withColumn("recent", F.count("*").over(frame))


def day_load(rows: DataFrame, keys: list[str], start: str, end: str, first: str, last: str) -> DataFrame:
    """(keys, day, seconds): busy time of each of the days, overlaps counted once; days without any are left out."""
    low, high = F.col(start).cast("timestamp"), F.col(end).cast("timestamp")
    inside = rows.where((high > low) & (low < F.date_add(F.lit(last).cast("date"), 1).cast("timestamp")) & (high > F.lit(first).cast("timestamp")))
    days = F.sequence(F.greatest(low.cast("date"), F.lit(first).cast("date")), F.least((high - F.make_dt_interval(secs=F.lit(0.000001))).cast("date"), F.lit(last).cast("date")))
    spread = inside.select(*keys, low.alias("__low"), high.alias("__high"), F.explode(days).alias("day"))
    clipped = spread.select(*keys, "day", F.greatest("__low", F.col("day").cast("timestamp")).alias("__s"), F.least("__high", F.date_add("day", 1).cast("timestamp")).alias("__e"))
    return busy_seconds(clipped, [*keys, "day"], "__s", "__e")


def unread(messages: DataFrame, done: DataFrame, extractor: str, version: int, *, key: str = "id") -> DataFrame:
    """The messages that an extractor hasn't read in this version or a later one."""
    seen = done.where((F.col("extractor") == extractor) & (F.col("version") >= version)).select(F.col("message_id").alias(key))
    return messages.join(seen, key, "left_anti")


def capped(rows: DataFrame, window: list, order: list[str], most: int) -> DataFrame:
    """The first ``most`` rows of each window."""
    place = Window.partitionBy(*window).orderBy(*order)
    return rows.withColumn("__rn", F.row_number().over(place)).where(F.col("__rn") <= most).drop("__rn")
