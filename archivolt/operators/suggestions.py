"""Rules drafted from values that people and models have given, the tree over them, and one rule for a whole value."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivolt.functions import text as X

# Fixed value: incoming mails of a sender or template that carry the value, at least.
LEAST = 20


def accepted(messages: DataFrame, effective: DataFrame, dimensions: list[str], *, least: int = LEAST) -> DataFrame:
    """(id, sender, skeleton, dimension, value): incoming mail of senders with enough of it, and its values given by people or models.

    A value that a rule gives is covered already and doesn't count.
    """
    mail = messages.where("medium = 'email' and direction = 'in' and coalesce(from_address, '') <> ''").select("id", F.col("from_address").alias("sender"), X.skeleton(F.col("subject")).alias("skeleton"))
    often = mail.groupBy("sender").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("sender")
    given = effective.where(F.col("source_kind").isin("human", "model") & F.col("dimension").isin(dimensions)).select(F.col("message_id").alias("id"), "dimension", "value")
    return mail.join(often, "sender", "left_semi").join(given, "id")


def suggestions(rows: DataFrame, *, least: int = LEAST) -> DataFrame:
    """(dimension, value, sender, skeleton, n): senders of one value alone, and of other senders the templates of one value; a null skeleton is the whole sender.

    ``rows``: ``accepted``.  A sender is suggested whole or by templates, so within a
    dimension no mail is covered twice.
    """
    counts = rows.groupBy("dimension", "sender", "skeleton", "value").agg(F.count("*").alias("n"))  # everything else is a sum of these
    sender = counts.groupBy("dimension", "sender").agg(F.min("value").alias("value"), F.max("value").alias("other"), F.sum("n").alias("n"))
    whole = sender.where((F.col("value") == F.col("other")) & (F.col("n") >= least)).select("dimension", "value", "sender", F.lit(None).cast("string").alias("skeleton"), "n")
    mixed = sender.where(F.col("value") != F.col("other")).select("dimension", "sender")
    by = counts.join(mixed, ["dimension", "sender"], "left_semi").groupBy("dimension", "sender", "skeleton")
    parts = by.agg(F.min("value").alias("value"), F.max("value").alias("other"), F.sum("n").alias("n")).where((F.col("value") == F.col("other")) & (F.col("n") >= least))
    return whole.unionByName(parts.select("dimension", "value", "sender", "skeleton", "n"))


def tree(found: DataFrame, family: Column) -> DataFrame:
    """(dimension, category, value, suggestions, covered): every level of field, category and value; null where a level is summed over."""
    return found.withColumn("category", family).rollup("dimension", "category", "value").agg(F.count("*").alias("suggestions"), F.sum("n").alias("covered")).where("dimension is not null")


def group_rules(found: DataFrame) -> DataFrame:
    """(dimension, value, members, senders, pairs): one broader rule for each value, an alternative of senders and of (sender, template) pairs.

    A rule lists its members, as many as there are suggestions of the value.
    """
    whole = F.col("skeleton").isNull()
    made = found.groupBy("dimension", "value").agg(F.count("*").alias("members"), F.array_sort(F.collect_set(F.when(whole, F.col("sender")))).alias("senders"), F.array_sort(F.collect_set(F.when(~whole, F.struct("sender", "skeleton")))).alias("pairs"))
    return made


def as_conditions(senders: list[str], pairs: list[tuple[str, str]]) -> list[dict]:
    """A group rule's condition in the rules' own form."""
    parts: list = [{"field": "from_address", "op": "in", "value": senders}] if senders else []
    parts += [[{"field": "from_address", "op": "is", "value": sender}, {"field": "subject", "op": "matches", "value": X.skeleton_regex(skeleton)}] for sender, skeleton in pairs]
    return [{"any": parts}]


def preview(found: DataFrame, messages: DataFrame, rows: DataFrame) -> DataFrame:
    """(dimension, value, matched, conflicting): what each value's group rule would match among incoming mail, and how much of it carries another accepted value."""
    mail = messages.where("medium = 'email' and direction = 'in'").select("id", F.col("from_address").alias("sender"), X.skeleton(F.col("subject")).alias("skeleton"))
    whole = found.where("skeleton is null").select("dimension", "value", "sender")
    pairs = found.where("skeleton is not null").select("dimension", "value", "sender", "skeleton")
    met = reduce(DataFrame.unionByName, [mail.join(whole, "sender").select("dimension", "value", "id"), mail.join(pairs, ["sender", "skeleton"]).select("dimension", "value", "id")])
    held = rows.select("id", "dimension", F.col("value").alias("held"))
    joined = met.join(held, ["id", "dimension"], "left")
    return joined.groupBy("dimension", "value").agg(F.count_distinct("id").alias("matched"), F.count_if(F.col("held") != F.col("value")).alias("conflicting"))
