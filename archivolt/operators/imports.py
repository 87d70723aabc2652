"""Imports of rules, taxonomies, labels and decisions: what a file would change, and what refuses it.

Every function returns the problems or the changes as rows.  A caller writes only
where the problems are empty, so a bad file never half lands.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fields of a rule whose change makes a new version; the other fields follow the file.
VERSIONED = ("conditions", "action")


def rule_changes(current: DataFrame, incoming: DataFrame, *, key: str = "id", versioned: tuple[str, ...] = VERSIONED) -> DataFrame:
    """(key, state, version): created, new version, updated, unchanged or absent from the file.

    ``current`` has ``version`` as well.  Fields are compared null-safe; keys are unique on both sides.
    """
    plain = [c for c in incoming.columns if c not in (key, *versioned)]
    was = current.select(key, "version", F.struct(*versioned).alias("__core"), F.struct(*plain).alias("__rest"))
    now = incoming.select(key, F.struct(*versioned).alias("__core2"), F.struct(*plain).alias("__rest2"))
    same_core, same_rest = F.col("__core").eqNullSafe(F.col("__core2")), F.col("__rest").eqNullSafe(F.col("__rest2"))
    state = F.when(F.col("__core2").isNull(), "absent").when(F.col("__core").isNull(), "created").when(~same_core, "new version").when(~same_rest, "updated").otherwise("unchanged")
    both = was.join(now, key, "full_outer").withColumn("state", state)
    version = F.when(F.col("state") == "created", 1).when(F.col("state") == "new version", F.col("version") + 1).otherwise(F.col("version"))
    return both.select(key, "state", version.cast("long").alias("version"))


def values_in_use(current: DataFrame, incoming: DataFrame, assignments: DataFrame) -> DataFrame:
    """(dimension, value, uses): values that a new taxonomy drops although active assignments use them; any row refuses it."""
    dropped = current.select("dimension", "value").distinct().join(incoming.select("dimension", "value"), ["dimension", "value"], "left_anti")
    used = assignments.where("status = 'active'").join(dropped, ["dimension", "value"], "left_semi")
    return used.groupBy("dimension", "value").agg(F.count("*").alias("uses"))


def label_problems(lines: DataFrame, items: DataFrame, allowed: DataFrame, fields: list[str]) -> DataFrame:
    """(item, field, problem) of an import of labels, a line per item with ``labels`` (field -> value) and ``unsure`` (fields).

    Problems: an item that the key lacks, an item twice, a field that is missing
    or unknown, a value outside the field's list, no value where the labeller is sure.
    """
    found = lines.select("item", F.coalesce("labels", F.create_map().cast("map<string,string>")).alias("labels"), F.coalesce("unsure", F.array().cast("array<string>")).alias("unsure"))
    none = F.lit(None).cast("string")
    strangers = found.select("item").distinct().join(items.select("item"), "item", "left_anti").select("item", none.alias("field"), F.lit("unknown item").alias("problem"))
    twice = found.groupBy("item").count().where("count > 1").select("item", none.alias("field"), F.lit("answered twice").alias("problem"))
    keys = F.map_keys("labels")
    wrong = lambda names, word: found.select("item", F.explode(names).alias("field"), F.lit(word).alias("problem"))
    known = F.array(*[F.lit(f) for f in fields])
    missing, extra = wrong(F.array_except(known, keys), "missing"), wrong(F.array_except(keys, known), "unknown field")
    said = found.select("item", "unsure", F.explode("labels").alias("field", "value")).where(F.col("field").isin(fields))
    blank = F.coalesce("value", F.lit("")) == ""
    empty = said.where(blank & ~F.array_contains("unsure", F.col("field"))).select("item", "field", F.lit("no value").alias("problem"))
    outside = said.where(~blank).join(allowed.select("field", "value"), ["field", "value"], "left_anti").select("item", "field", F.lit("not allowed").alias("problem"))
    return reduce(DataFrame.unionByName, [strangers, twice, missing, extra, empty, outside]).distinct()


def decision_problems(decisions: DataFrame, expected: DataFrame, allowed: list[str], holds: list[str]) -> DataFrame:
    """(case_id, problem): decisions on cases that the run didn't ask, twice, without a value or a hold, or with one outside the lists."""
    asked = decisions.join(expected.select("case_id").distinct().withColumn("__asked", F.lit(True)), "case_id", "left")
    counted = decisions.groupBy("case_id").count().where("count > 1").select("case_id", F.lit("answered twice").alias("problem"))
    value, hold = F.coalesce("value", F.lit("")), F.coalesce("hold", F.lit(""))
    problem = (
        F.when(F.col("__asked").isNull(), "not in the run")
        .when((hold != "") & ~hold.isin(holds), "unknown hold")
        .when((hold == "") & (value == ""), "neither value nor hold")
        .when((hold == "") & ~value.isin(allowed), "not allowed")
    )
    return asked.select("case_id", problem.alias("problem")).where("problem is not null").unionByName(counted).distinct()


def decision_proposals(decisions: DataFrame, expected: DataFrame, dimension: str) -> DataFrame:
    """(case_id, dimension, value, status): a valid file as proposals; a hold is a tag; cases without an answer are unanswered."""
    held = F.coalesce("hold", F.lit("")) != ""
    said = decisions.select("case_id", F.when(held, "tag").otherwise(dimension).alias("dimension"), F.when(held, F.concat(F.lit("hold:"), "hold")).otherwise(F.col("value")).alias("value"), F.lit("proposed").alias("status"))
    rows = expected.select("case_id").distinct().join(said, "case_id", "left")
    return rows.withColumn("status", F.coalesce("status", F.lit("unanswered")))


def next_status(status: Column, verdict: Column, human: Column) -> Column:
    """The state of an asserted value after a verdict.

    A proposal is accepted (active) or rejected; under a human value a proposal is
    superseded; an active value is rejected or superseded; the rest is final.
    """
    return (
        F.when((status == "proposed") & human, "superseded")
        .when((status == "proposed") & (verdict == "accept"), "active")
        .when(status.isin("proposed", "active") & (verdict == "reject"), "rejected")
        .when((status == "active") & (verdict == "replace"), "superseded")
        .otherwise(status)
    )


def stale(rows: DataFrame, version: int, *, after: int = 0, limit: int = 200) -> DataFrame:
    """The next rows by id that an older parser made: one batch of a catch-up by keyset."""
    return rows.where((F.col("parser_version") < version) & (F.col("id") > after)).orderBy("id").limit(limit)


def refuses_cycle(wanted: DataFrame, reach: DataFrame) -> DataFrame:
    """``wanted`` (child, parent) with ``refused``: the parent is the child itself or below it.

    ``reach``: (root, id) of everything below each child that is asked about.
    """
    below = reach.select(F.col("root").alias("child"), F.col("id").alias("parent")).distinct().withColumn("__below", F.lit(True))
    held = wanted.join(below, ["child", "parent"], "left")
    return held.withColumn("refused", F.coalesce("__below", F.lit(False)) | (F.col("child") == F.col("parent"))).drop("__below")


def run_outcomes(rows: DataFrame, run: str, error: str) -> DataFrame:
    """(run, seen, failed, outcome): ok without failures, failed with nothing else, else partial."""
    counted = rows.groupBy(run).agg(F.count("*").alias("seen"), F.count(error).alias("failed"))
    outcome = F.when(F.col("failed") == 0, "ok").when(F.col("failed") == F.col("seen"), "failed").otherwise("partial")
    return counted.withColumn("outcome", outcome)


def size_batches(rows: DataFrame, key: str, most: int, size: str, most_size: int) -> DataFrame:
    """``rows`` with ``batch``: the number of a batch of at most ``most`` rows and, a larger single row apart, ``most_size`` in all.

    ``key`` orders the rows within blocks of ``most``; in a block a new batch
    starts wherever the running size passes a multiple of half the bound, so
    no batch exceeds it and no row waits for all before it.
    """
    block = F.floor(F.col(key) / most)
    upto = Window.partitionBy(block).orderBy(key)
    half = most_size / 2
    large = F.col(size) > half
    runs = F.sum(F.when(large, 0).otherwise(F.col(size))).over(upto.rowsBetween(Window.unboundedPreceding, 0))
    alone = F.sum(large.cast("int")).over(upto.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("batch", F.concat_ws(":", block, F.when(large, F.concat(F.lit("x"), alone)).otherwise(F.floor((runs - 1) / half))))


def cursors(rows: DataFrame, scope: str, id_: str) -> DataFrame:
    """(scope, last_id, n): how far each scope has been read, and how much of it."""
    return rows.groupBy(scope).agg(F.max(id_).alias("last_id"), F.count("*").alias("n"))
