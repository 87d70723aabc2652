"""Markdown files: notes with a head of fields, and documents cut at their headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_HEAD = r"(?s)\A---\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\z)"


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text) of the Markdown files below a folder."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def _pairs(head: Column) -> Column:
    """``key: value`` lines as a map; of a key given twice the last value counts, quotes around a value go."""
    lines = F.filter(F.split(head, r"\r?\n"), lambda x: F.rlike(x, F.lit(r"^[A-Za-z_][\w-]*\s*:")))
    pair = lambda x: F.struct(F.trim(F.split_part(x, F.lit(":"), F.lit(1))).alias("k"), F.regexp_replace(F.trim(F.regexp_replace(x, r"^[^:]*:", "")), "^[\"'](.*)[\"']$", "$1").alias("v"))
    made = F.transform(lines, pair)
    last = F.filter(made, lambda p, i: ~F.exists(F.slice(made, i + 2, F.size(made)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def parsed(notes: DataFrame) -> DataFrame:
    """(path, fields, body, fingerprint): the head as a map, empty without one; the fingerprint is that of the whole text."""
    text = F.coalesce("text", F.lit(""))
    return notes.select("path", _pairs(F.regexp_extract(text, _HEAD, 1)).alias("fields"), F.regexp_replace(text, _HEAD, "").alias("body"), F.sha2(text, 256).alias("fingerprint"))


def changes(known: DataFrame, notes: DataFrame) -> DataFrame:
    """(path, change): new, changed, unchanged or gone since the fingerprints in ``known``."""
    was = known.select("path", F.col("fingerprint").alias("__was"))
    both = was.join(notes.select("path", F.col("fingerprint").alias("__now")), "path", "full_outer")
    change = F.when(F.col("__was").isNull(), "new").when(F.col("__now").isNull(), "gone").when(F.col("__was") == F.col("__now"), "unchanged").otherwise("changed")
    return both.select("path", change.alias("change"))


def sections(notes: DataFrame, level: int = 2) -> DataFrame:
    """(path, ordinal, heading, body): a text cut at the headings of a level; what stands before the first has a null heading."""
    marked = F.regexp_replace(F.coalesce("text", F.lit("")), rf"(?m)^#{{{level}}}[ \t]+", "\x00")
    rows = notes.select("path", F.posexplode(F.split(marked, "\x00")).alias("ordinal", "part"))
    heading = F.when(F.col("ordinal") > 0, F.trim(F.split_part("part", F.lit("\n"), F.lit(1))))
    body = F.when(F.col("ordinal") > 0, F.regexp_replace("part", r"\A[^\n]*\n?", "")).otherwise(F.col("part"))
    return rows.select("path", "ordinal", heading.alias("heading"), F.trim(F.regexp_replace(body, r"\A\s+|\s+\z", "")).alias("body")).where("heading is not null or body <> ''")
