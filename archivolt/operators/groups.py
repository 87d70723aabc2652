"""Selections and notes over groups: focus, missing fields, neighbours, resolution, warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def focus(answers: DataFrame, uncertain: Column, unit: str = "unit") -> DataFrame:
    """All answers of the units that hold an uncertain one."""
    return answers.join(answers.where(uncertain).select(unit).distinct(), unit, "left_semi")


def missing_fields(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, missing, n): which fields are unset together, and how often."""
    unset = F.array_compact(F.array(*[F.when(F.coalesce(F.col(f).cast("string"), F.lit("")) == "", F.lit(f)) for f in fields]))
    return rows.groupBy(key, F.array_join(unset, ",").alias("missing")).agg(F.count("*").alias("n"))


def suggestion_tree(rows: DataFrame, levels: list[str]) -> DataFrame:
    """(levels, n): counts at every depth of a tree, deeper levels null above them."""
    return rows.rollup(*levels).agg(F.count("*").alias("n"), F.grouping_id().alias("__g")).where(F.col("__g") != (1 << len(levels)) - 1).drop("__g")


def common_links(members: DataFrame, links: DataFrame, *, least: int) -> DataFrame:
    """(other, n): what several members of a set link to, and isn't a member itself."""
    met = links.join(members.select("id"), "id").groupBy("other").agg(F.count_distinct("id").alias("n")).where(F.col("n") >= least)
    return met.join(members.select(F.col("id").alias("other")), "other", "left_anti")


def resolve(rows: DataFrame, ways: list[tuple[str, DataFrame]]) -> DataFrame:
    """``rows`` with ``entity``: by the first way that knows the row's key.

    A way is a key column of ``rows`` and a table (key, entity); of several
    entities the smallest counts.
    """
    out, found = rows, []
    for i, (key, known) in enumerate(ways):
        once = known.groupBy(F.col("key").alias(key)).agg(F.min("entity").alias(f"__way{i}"))
        out = out.join(once, key, "left")
        found.append(F.col(f"__way{i}"))
    return out.withColumn("entity", F.coalesce(*found)).drop(*[f"__way{i}" for i in range(len(ways))])


def undo_state(changes: DataFrame) -> DataFrame:
    """(id, state) of changes (id, undo_of): undone where a later change undoes it."""
    undone = changes.where("undo_of is not null").groupBy(F.col("undo_of").alias("id")).agg(F.min("id").alias("by"))
    return changes.join(undone, "id", "left").select("id", F.when(F.col("by") > F.col("id"), "undone").when(F.col("undo_of").isNotNull(), "undo").otherwise("done").alias("state"))


def new_domains(recipients: DataFrame, known: DataFrame) -> DataFrame:
    """Recipients at domains that were never met."""
    of = lambda rows: rows.withColumn("domain", F.lower(F.split_part("address", F.lit("@"), F.lit(2))))
    return of(recipients).join(of(known).select("domain").distinct(), "domain", "left_anti")
