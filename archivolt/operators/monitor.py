"""State of monitored services from their check-ins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def status(paused: Column, last: Column, ok: Column, expected: Column, grace_seconds: Column, now: Column) -> Column:
    """paused, unknown, failing, up, late (a grace after the deadline) or down (two graces after)."""
    over = F.unix_micros(now) - F.unix_micros(expected.cast("timestamp"))
    grace = grace_seconds.cast("long") * 1_000_000
    return (
        F.when(paused, "paused")
        .when(last.isNull(), "unknown")
        .when(~F.coalesce(ok, F.lit(True)), "failing")
        .when(expected.isNull() | (over < grace), "up")
        .when(over < 2 * grace, "late")
        .otherwise("down")
    )


def dense_days(rows: DataFrame, key: str, at: str, last_day: str, days: int) -> DataFrame:
    """(key, day, n) for every key and each of the last days, zero where nothing happened."""
    last = F.lit(last_day).cast("date")
    calendar = rows.select(key).distinct().select(key, F.explode(F.sequence(F.date_sub(last, days - 1), last)).alias("day"))
    counted = rows.groupBy(key, F.col(at).cast("date").alias("day")).agg(F.count("*").alias("n"))
    return calendar.join(counted, [key, "day"], "left").select(key, "day", F.coalesce("n", F.lit(0)).alias("n"))
