"""The report over a placement: why a message stands where it does, counts, old places, the tree, what is left to do."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivolt.operators.placement import vocabulary
from archivolt.plans.conditions import first_match, in_words, placement_column

TO_SORT, UNPLACED = "To sort", "(no rule)"
#: Places that a provider makes itself, which tell nothing of an owner's old order.
NOT_OLD = ("[all]", "\\Important", "\\Sent", "\\Draft", "\\Starred")


@dataclass(frozen=True)
class Target:
    """A place of an account with the conditions that all have to hold; ``kind``: label, inbox (only what is there stays) or leave."""

    id: str
    path: str
    kind: str
    when: list[dict]


def with_locations(rows: DataFrame, locations: DataFrame) -> DataFrame:
    """``rows`` with ``olds`` (present folders and labels, sorted) and ``in_inbox``."""
    present = locations.where("present").groupBy(F.col("message_id").alias("id"))
    place = F.coalesce("folder_path", "folder")
    held = present.agg(F.array_sort(F.array_distinct(F.concat(F.collect_set(place), F.collect_set("label")))).alias("olds"), F.bool_or(F.col("folder") == "INBOX").alias("in_inbox"))
    out = rows.join(held, "id", "left")
    return out.withColumn("olds", F.coalesce("olds", F.array().cast("array<string>"))).withColumn("in_inbox", F.coalesce("in_inbox", F.lit(False)))


def _conditions(target: Target, words) -> list[tuple[str, Column]]:
    parts = [("in the inbox now", F.col("in_inbox"))] if target.kind == "inbox" else []
    return parts + [(in_words(c), F.coalesce(placement_column(c, words), F.lit(False))) for c in target.when]


def _holds(target: Target, words) -> Column:
    return reduce(Column.__and__, [ok for _, ok in _conditions(target, words)], F.lit(True))


def placed(rows: DataFrame, targets: dict[str, list[Target]], *, named: dict | None = None) -> DataFrame:
    """``rows`` with rule_id, target, place and leaves_inbox: the first target of their account whose conditions hold.

    Rows of an account without targets, and those that none takes, are to sort.
    """
    words = vocabulary(rows, named)
    chosen = F.lit(None).cast("struct<rule_id:string,target:string,place:string>")
    for account, mine in targets.items():
        told = [(F.struct(F.lit(t.id).alias("rule_id"), F.lit(t.path).alias("target"), F.lit(t.kind).alias("place")), _holds(t, words)) for t in mine]
        if told:
            first = reduce(lambda out, x: out.when(x[1], x[0]), told[1:], F.when(told[0][1], told[0][0]))
            chosen = F.when(F.col("account") == account, first).otherwise(chosen)
    rest = F.struct(F.lit(UNPLACED).alias("rule_id"), F.lit(TO_SORT).alias("target"), F.lit("label").alias("place"))
    out = rows.withColumn("__to", F.coalesce(chosen, rest)).select(*[F.col(f"`{c}`") for c in rows.columns], "__to.*")
    return out.withColumn("leaves_inbox", F.col("in_inbox") & (F.col("place") == "label"))


def why(rows: DataFrame, targets: dict[str, list[Target]], *, named: dict | None = None) -> DataFrame:
    """(id, account, tests): every target of the account in order, with the truth of each condition, and which is the first to hold.

    ``tests``: rule_id, target, place, matched, first, conditions (text, ok).  It is
    one projection, so it answers for one row or for all.
    """
    words = vocabulary(rows, named)
    condition = lambda text, ok: F.struct(F.lit(text).alias("text"), ok.alias("ok"))
    kind = "array<struct<rule_id:string,target:string,place:string,matched:boolean,first:boolean,conditions:array<struct<text:string,ok:boolean>>>>"
    out = F.array().cast(kind)
    for account, mine in targets.items():
        first = first_match([(t.id, _holds(t, words)) for t in mine]) if mine else F.lit(None)
        tests = [
            F.struct(
                F.lit(t.id).alias("rule_id"),
                F.lit(t.path).alias("target"),
                F.lit(t.kind).alias("place"),
                _holds(t, words).alias("matched"),
                F.coalesce(first == t.id, F.lit(False)).alias("first"),
                F.array(*[condition(text, ok) for text, ok in _conditions(t, words)]).cast("array<struct<text:string,ok:boolean>>").alias("conditions"),
            )
            for t in mine
        ]
        out = F.when(F.col("account") == account, F.array(*tests).cast(kind)).otherwise(out)
    return rows.select("id", "account", out.alias("tests"))


def _same(old: dict[str, dict[str, str]]) -> Column:
    """Whether one of a row's old places maps to its target."""
    held = F.lit(False)
    for account, pairs in old.items():
        for name, new in pairs.items():
            held = held | ((F.col("account") == account) & F.array_contains("olds", name) & (F.col("target") == new))
    return held


def totals(rows: DataFrame, old: dict[str, dict[str, str]]) -> DataFrame:
    """A row per account: messages, the inbox before and after, to sort, left alone, already in a place that maps to their target."""
    rest = F.col("in_inbox") & ~F.col("leaves_inbox")
    return rows.groupBy("account").agg(
        F.count("*").alias("total"),
        F.count_if("in_inbox").alias("inbox_before"),
        F.count_if(rest).alias("inbox_after"),
        F.count_if("leaves_inbox").alias("leaves_inbox"),
        F.count_if(F.col("target") == TO_SORT).alias("to_sort"),
        F.count_if(F.col("place") == "leave").alias("left_alone"),
        F.count_if(_same(old)).alias("same_place"),
    )


def by_target(rows: DataFrame) -> DataFrame:
    """A row per account, target and the rule that places there."""
    return rows.groupBy("account", "target", "place", "rule_id").agg(F.count("*").alias("n"), F.count_if("in_inbox").alias("in_inbox"), F.count_if("leaves_inbox").alias("leaves_inbox"))


def old_places(rows: DataFrame, old: dict[str, dict[str, str]], *, top: int = 4) -> DataFrame:
    """(account, old, n, maps_to, same, targets): where the messages of each old place go, the ``top`` targets with counts (ties by name)."""
    each = rows.select("account", "target", F.explode("olds").alias("old")).where(~F.col("old").isin(*NOT_OLD))
    counts = each.groupBy("account", "old", "target").agg(F.count("*").alias("n"))
    mapped = F.lit(None).cast("string")
    for account, pairs in old.items():
        for name, new in pairs.items():
            mapped = F.when((F.col("account") == account) & (F.col("old") == name), new).otherwise(mapped)
    named = counts.withColumn("maps_to", mapped)
    found = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "target")))  # as many as there are targets
    made = named.groupBy("account", "old", "maps_to").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("target") == F.col("maps_to"), F.col("n"))), F.lit(0)).alias("same"), found.alias("found"))
    return made.select("account", "old", "n", "maps_to", "same", F.transform(F.slice("found", 1, top), lambda x: F.struct(x["target"].alias("target"), (-x["less"]).alias("n"))).alias("targets"))


def tree(rows: DataFrame) -> DataFrame:
    """(account, path, depth, leaf, n, in_inbox, leaves_inbox): every node over the targets' paths with all that lies under it."""
    counts = rows.groupBy("account", "target").agg(F.count("*").alias("n"), F.count_if("in_inbox").alias("in_inbox"), F.count_if("leaves_inbox").alias("leaves_inbox"))
    parts = F.split("target", "/")
    nodes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, 1, k), "/").alias("path"), k.alias("depth")))
    each = counts.select("account", "target", "n", "in_inbox", "leaves_inbox", F.explode(nodes).alias("node")).select("*", "node.*")
    sums = [F.sum(c).alias(c) for c in ("n", "in_inbox", "leaves_inbox")]
    return each.groupBy("account", "path", "depth").agg(F.bool_or(F.col("path") == F.col("target")).alias("leaf"), *sums)


def examples(rows: DataFrame, account: str, target: str, *, rule: str | None = None, limit: int = 25, offset: int = 0) -> DataFrame:
    """(id, received_at, target, rule_id) at a target or under it, newest first, missing times last, ties by id."""
    under = (F.col("target") == target) | F.startswith("target", F.lit(target + "/"))
    found = rows.where((F.col("account") == account) & under)
    if rule is not None:
        found = found.where(F.col("rule_id") == rule)
    return found.select("id", "received_at", "target", "rule_id").orderBy(F.desc_nulls_last("received_at"), "id").offset(offset).limit(limit)


def checklist(rows: DataFrame, operations: DataFrame) -> DataFrame:
    """(account, step, target, planned, on_server, waiting, to_prepare): what still has to be prepared.

    Step ``label`` counts a target's messages that carry its label, or wait for it in
    an open operation (message_id, op, label); step ``archive`` those that leave the inbox:
    ``on_server`` are there still, and can be prepared once they carry their label.
    """
    mine = rows.where("place = 'label'").select("id", "account", "target", "in_inbox", "leaves_inbox", F.array_contains("olds", F.col("target")).alias("labelled"))
    asked = operations.groupBy(F.col("message_id").alias("id")).agg(F.collect_set(F.when(F.col("op") == "add_label", F.col("label"))).alias("labels"), F.bool_or(F.col("op") == "archive").alias("archive"))
    known = mine.join(asked, "id", "left")
    wait = F.coalesce(F.array_contains("labels", F.col("target")), F.lit(False))
    label = known.groupBy("account", "target").agg(F.count("*").alias("planned"), F.count_if("labelled").alias("on_server"), F.count_if(~F.col("labelled") & wait).alias("waiting"))
    label = label.select("account", F.lit("label").alias("step"), "target", "planned", "on_server", "waiting", (F.col("planned") - F.col("on_server") - F.col("waiting")).alias("to_prepare"))
    there = F.col("in_inbox") & F.coalesce("archive", F.lit(False))
    archive = known.where("leaves_inbox").groupBy("account").agg(F.count("*").alias("planned"), F.count_if("in_inbox").alias("on_server"), F.count_if(there).alias("waiting"), F.count_if(F.col("in_inbox") & F.col("labelled")).alias("ready"))
    prepare = F.greatest(F.lit(0).cast("long"), F.col("ready") - F.col("waiting"))
    return label.unionByName(archive.select("account", F.lit("archive").alias("step"), F.lit("").alias("target"), "planned", "on_server", "waiting", prepare.alias("to_prepare")))
