"""Where messages belong, and what moving them would take (plans only: nothing is moved)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivolt.operators import values as V
from archivolt.plans.conditions import Vocabulary, first_match, placement_column


def features(messages: DataFrame, assignments: DataFrame, locations: DataFrame, dimensions: list[str], now: str) -> DataFrame:
    """``messages`` with a column per dimension, the present labels, and the age in days."""
    pivoted = V.pivot_values(V.effective_message_values(messages.select("id", "thread_id"), assignments.where(F.col("dimension").isin(dimensions))), dimensions)
    labels = locations.where("present").groupBy(F.col("message_id").alias("id")).agg(F.collect_set("label").alias("labels"))
    rows = messages.join(pivoted.withColumnRenamed("message_id", "id"), "id", "left").join(labels, "id", "left")
    return rows.withColumn("age", F.datediff(F.lit(now).cast("timestamp"), "received_at"))


def vocabulary(rows: DataFrame, named: dict | None) -> Vocabulary:
    """The columns of ``rows`` as fields, by type."""
    of = {"string": "scalars", "boolean": "booleans", "array<string>": "arrays"}
    kinds: dict[str, dict] = {"scalars": {}, "booleans": {}, "numbers": {}, "arrays": {}}
    for name, kind in rows.dtypes:
        kinds[of.get(kind, "numbers")][name] = F.col(name)
    return Vocabulary(**kinds, named=named or {})


def place(rows: DataFrame, targets: list[tuple[str, dict]], *, otherwise: str = "To sort", named: dict | None = None) -> DataFrame:
    """``rows`` with ``place``: the first target whose condition holds, in one projection."""
    words = vocabulary(rows, named)
    return rows.withColumn("place", first_match([(name, placement_column(c, words)) for name, c in targets], F.lit(otherwise)))


def why(rows: DataFrame, targets: list[tuple[str, dict]]) -> DataFrame:
    """``rows`` with ``reasons``: every target whose condition holds, in order."""
    words = vocabulary(rows, None)
    held = [F.when(placement_column(c, words), F.lit(name)) for name, c in targets]
    return rows.withColumn("reasons", F.array_compact(F.array(*held)))


def unanimous(rows: DataFrame, key: str, value: str, *, least: int) -> DataFrame:
    """(key, value, n): keys of which all values agree, with at least that many rows."""
    made = rows.where(F.col(value).isNotNull()).groupBy(key).agg(F.min(value).alias("value"), F.max(value).alias("__most"), F.count("*").alias("n"))
    return made.where((F.col("value") == F.col("__most")) & (F.col("n") >= least)).drop("__most")


def plan_archive(messages: DataFrame, locations: DataFrame) -> DataFrame:
    """(id, op, inverse): what archiving each message would do, or why it is skipped."""
    held = locations.groupBy(F.col("message_id").alias("id")).agg(F.bool_or("present").alias("held"), F.bool_or(F.col("present") & (F.col("folder") == "INBOX")).alias("inbox"))
    rows = messages.join(held, "id", "left")
    op = F.when(~F.coalesce("held", F.lit(False)), "skip:gone").when(~F.col("inbox"), "skip:not_in_inbox").when(F.col("has_attachments"), "skip:protected").otherwise("archive")
    return rows.select("id", op.alias("op")).withColumn("inverse", F.when(F.col("op") == "archive", "move_to_inbox"))
