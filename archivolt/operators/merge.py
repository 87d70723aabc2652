"""Write operators as pure functions: what a table becomes, never an update in place."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def differs(left: list[Column], right: list[Column]) -> Column:
    """Null-safe row difference."""
    return ~F.struct(*left).eqNullSafe(F.struct(*right))


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """``current`` after ``incoming``, with ``change``: added, changed, unchanged or kept (not in ``incoming``).

    Both sides have unique keys and the same columns.
    """
    rest = [c for c in current.columns if c not in keys]
    old = current.select(*keys, F.struct(*rest).alias("__old"))
    new = incoming.select(*keys, F.struct(*rest).alias("__new"))
    both = old.join(new, keys, "full_outer")
    change = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "kept").when(differs([F.col("__old")], [F.col("__new")]), "changed").otherwise("unchanged")
    held = F.coalesce("__new", "__old")
    return both.select(*keys, *[held[c].alias(c) for c in rest], change.alias("change"))


def insert_missing(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """``current`` and the rows of ``incoming`` whose keys it lacks."""
    return current.unionByName(incoming.join(current.select(*keys), keys, "left_anti").select(current.columns))


def mark_gone(known: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """``known`` with ``gone``: whether a snapshot no longer has the key."""
    flagged = known.join(seen.select(*keys).distinct().withColumn("__seen", F.lit(True)), keys, "left")
    return flagged.withColumn("gone", F.col("__seen").isNull()).drop("__seen")


def replace_own(current: DataFrame, fresh: DataFrame, ref: str, prefix: str) -> DataFrame:
    """``current`` without the rows whose ``ref`` starts with ``prefix``, plus ``fresh``."""
    return current.where(~F.coalesce(F.startswith(ref, F.lit(prefix)), F.lit(False))).unionByName(fresh)


def supersede(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``rows`` with ``status``: the first of each key is active, the others superseded."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1
    return rows.withColumn("status", F.when(first, "active").otherwise("superseded"))


def three_way(current: DataFrame, incoming: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, outcome): what an import does to each record.

    ``current`` has the fields, ``file_hash`` and ``fingerprint`` of the last
    import; ``incoming`` has ``file_hash``.  An edited record is kept as the owner
    left it; an unedited one follows the file.
    """
    now = current.withColumn("__now", F.sha2(F.to_json(F.struct(*fields)), 256))
    both = now.select(key, "file_hash", "fingerprint", "__now").join(incoming.select(key, F.col("file_hash").alias("__file")), key, "full_outer")
    same_file = F.col("file_hash").eqNullSafe(F.col("__file"))
    outcome = (
        F.when(F.col("__now").isNull(), "created")
        .when(F.col("__file").isNull(), "missing")
        .when(same_file, "unchanged")
        .when(F.col("__now") != F.col("fingerprint"), "kept_edit")
        .otherwise("updated")
    )
    return both.select(key, outcome.alias("outcome"))


def keep_decisions(current: DataFrame, incoming: DataFrame, keys: list[str], decision: str = "decision") -> DataFrame:
    """``incoming`` with earlier decisions; a file's own decision counts only where there is none.  Vanished keys stay, flagged."""
    rest = [c for c in incoming.columns if c not in [*keys, decision]]
    old = current.select(*keys, F.col(decision).alias("__kept"), F.struct(*rest).alias("__was"), F.lit(True).alias("__had"))
    both = incoming.withColumn("__here", F.lit(True)).join(old, keys, "full_outer")
    here = F.coalesce("__here", F.lit(False))
    return both.select(*keys, *[F.when(here, F.col(c)).otherwise(F.col("__was")[c]).alias(c) for c in rest], F.coalesce("__kept", decision).alias(decision), (~here).alias("vanished"))


def sticky_labels(labels: DataFrame, keys: list[str], order: list[Column], flag: str) -> DataFrame:
    """The latest label of each key, its flag set once any of them had it."""
    window = Window.partitionBy(*keys)
    ranked = labels.withColumn("__any", F.bool_or(flag).over(window)).withColumn("__rn", F.row_number().over(window.orderBy(*order)))
    return ranked.where("__rn = 1").withColumn(flag, F.col("__any")).drop("__rn", "__any")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def refresh(current: DataFrame, touched: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """``current`` with the rows of touched keys replaced by ``fresh``: late data recomputes its own groups alone."""
    return current.join(touched.select(*keys).distinct(), keys, "left_anti").select(current.columns).unionByName(fresh)
