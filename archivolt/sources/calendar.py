"""Calendar files (iCalendar) as rows, read with Spark's text functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _property(block: Column, name: str) -> Column:
    """The value of a property, its parameters skipped; null where it is missing."""
    found = F.regexp_extract(block, rf"(?m)^{name}(?:;[^:\r\n]*)?:([^\r\n]*)", 1)
    return F.nullif(F.trim(found), F.lit(""))


def _text(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(value, r"\\[nN]", "\n"), r"\\([,;\\])", "$1")


def _time(value: Column, zone: Column) -> Column:
    """A moment in UTC: Z is UTC, else the zone that the property names, else UTC; a bare date is its midnight."""
    digits = F.regexp_replace(value, "[TZ]", "")
    at = F.try_to_timestamp(F.when(F.length(digits) == 8, F.concat(digits, F.lit("000000"))).otherwise(digits), F.lit("yyyyMMddHHmmss"))
    local = (zone != "") & ~F.endswith(value, F.lit("Z")) & (F.length(digits) > 8)
    return F.when(local, F.to_utc_timestamp(at, zone)).otherwise(at)


def entries(texts: DataFrame, *, text: str = "text") -> DataFrame:
    """(uid, occurrence, summary, starts_at, ends_at, all_day, show_as): the events of calendar texts; the latest version of each stays.

    An occurrence of a series shares the series' uid and names its own time
    (RECURRENCE-ID); ``occurrence`` is that, null for the series and for single events.
    Folded lines are joined first.  An event without a uid or a start is left out;
    one without an end lasts a day if it is of whole days, else no time.
    """
    whole = F.regexp_replace(F.coalesce(F.col(f"`{text}`"), F.lit("")), r"\r?\n[ \t]", "")
    block = texts.select(F.explode(F.regexp_extract_all(whole, F.lit(r"(?s)BEGIN:VEVENT\r?\n(.*?)END:VEVENT"), 1)).alias("b"))
    zone = lambda name: F.regexp_extract("b", rf"(?m)^{name};[^:\r\n]*TZID=([A-Za-z_+/-]+)", 1)
    rows = block.select(
        _property(F.col("b"), "UID").alias("uid"),
        _time(_property(F.col("b"), "RECURRENCE-ID"), zone("RECURRENCE-ID")).alias("occurrence"),
        _text(_property(F.col("b"), "SUMMARY")).alias("summary"),
        _time(_property(F.col("b"), "DTSTART"), zone("DTSTART")).alias("starts_at"),
        _time(_property(F.col("b"), "DTEND"), zone("DTEND")).alias("ends_at"),
        (F.length(_property(F.col("b"), "DTSTART")) == 8).alias("all_day"),
        F.when(_property(F.col("b"), "STATUS") == "CANCELLED", "cancelled").when(_property(F.col("b"), "TRANSP") == "TRANSPARENT", "free").otherwise("busy").alias("show_as"),
        F.coalesce(_property(F.col("b"), "SEQUENCE").try_cast("int"), F.lit(0)).alias("__sequence"),
    ).where("uid is not null and starts_at is not null")
    ends = F.coalesce("ends_at", F.when(F.col("all_day"), F.col("starts_at") + F.make_dt_interval(days=F.lit(1))).otherwise(F.col("starts_at")))
    rows = rows.withColumn("ends_at", ends)
    names = ["summary", "starts_at", "ends_at", "all_day", "show_as"]
    newest = rows.groupBy("uid", "occurrence").agg(F.max_by(F.struct(*names), F.struct("__sequence", "starts_at")).alias("e"))
    return newest.select("uid", "occurrence", "e.*")


def read(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.ics").text(folder, wholetext=True)
    return entries(files, text="value")
