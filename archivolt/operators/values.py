"""Effective values: one winner per entity and dimension among asserted values.

People beat rules, rules beat accepted models, models beat imports; then a
message's own value beats its thread's, then the newest, then the highest id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The ranks of sources.
TIERS = {"human": 4, "rule": 3, "model": 2, "import": 1}
#: Dimensions in which every active value counts.
MANY = ("tag",)
#: The values of origin and sender_kind that mean a machine.
MACHINE = ("auto_reply", "transactional", "notification", "alert", "marketing", "machine")


def tier(source_kind: Column) -> Column:
    out = F.lit(0)
    for kind, rank in TIERS.items():
        out = F.when(source_kind == kind, rank).otherwise(out)
    return out


def candidates(messages: DataFrame, assignments: DataFrame) -> DataFrame:
    """Active assignments per message, its own and its thread's: two equi joins, not one on OR."""
    active = assignments.where(F.col("status") == "active").withColumnRenamed("id", "assignment_id").drop("status")
    own = messages.select(F.col("id").alias("message_id"), F.col("id").alias("entity_id"), F.lit(True).alias("own"))
    thread = messages.where("thread_id is not null").select(F.col("id").alias("message_id"), F.col("thread_id").alias("entity_id"), F.lit(False).alias("own"))
    return own.unionByName(thread).join(active, "entity_id")


def _order() -> list[Column]:
    return [F.desc(tier(F.col("source_kind"))), F.desc("own"), F.desc_nulls_last("created_at"), F.desc("assignment_id")]


def effective_message_values(messages: DataFrame, assignments: DataFrame, many: tuple[str, ...] = MANY) -> DataFrame:
    """(message_id, dimension, value, source_kind, confidence, assignment_id, via): the values that count."""
    rows = candidates(messages, assignments)
    is_many = F.col("dimension").isin(list(many))
    # a dimension of many values ranks within each value, the others within the dimension
    key = F.when(is_many, F.col("value"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("message_id", "dimension", key).orderBy(*_order())))
    won = ranked.where("rank = 1")
    return won.select("message_id", "dimension", "value", "source_kind", "confidence", "assignment_id", F.when(F.col("own"), "message").otherwise("thread").alias("via"))


def effective_values(assignments: DataFrame, many: tuple[str, ...] = MANY) -> DataFrame:
    """(entity_id, dimension, value, source_kind, assignment_id) without regard to threads."""
    rows = assignments.where(F.col("status") == "active")
    key = F.when(F.col("dimension").isin(list(many)), F.col("value"))
    order = Window.partitionBy("entity_id", "dimension", key).orderBy(F.desc(tier(F.col("source_kind"))), F.desc_nulls_last("created_at"), F.desc("id"))
    return rows.withColumn("rank", F.row_number().over(order)).where("rank = 1").select("entity_id", "dimension", "value", "source_kind", F.col("id").alias("assignment_id"))


def machine_made(messages: DataFrame, assignments: DataFrame) -> DataFrame:
    """``messages`` with ``machine``: by sender_kind and origin in one ranking, else the parser's flag."""
    rows = candidates(messages, assignments.where(F.col("dimension").isin("sender_kind", "origin")))
    boundary = (F.col("dimension") == "sender_kind").cast("int")
    rank = F.struct(tier(F.col("source_kind")).alias("tier"), boundary.alias("boundary"), F.col("own").cast("int").alias("own"), "created_at", "assignment_id")
    best = rows.groupBy("message_id").agg(F.max_by(F.col("value").isin(list(MACHINE)), rank).alias("ranked"))
    return messages.join(best.withColumnRenamed("message_id", "id"), "id", "left").withColumn("machine", F.coalesce("ranked", "is_automated")).drop("ranked")


def pivot_values(effective: DataFrame, dimensions: list[str]) -> DataFrame:
    """A column per dimension of the one-value kind."""
    return effective.groupBy("message_id").pivot("dimension", dimensions).agg(F.max("value"))


# --- sureness ----------------------------------------------------------------------

#: Levels of sureness with their lowest confidence.
LEVELS = (("certain", 0.95), ("confident", 0.85), ("likely", 0.70), ("maybe", 0.50), ("doubtful", 0.30))
#: What a source counts as.
SOURCE_CONFIDENCE = {"human": 1.0, "rule": 0.97, "import": 0.75}
UNSTATED = 0.75
EPSILON = 1e-9


def sure_confidence(source_kind: Column, confidence: Column) -> Column:
    out = F.coalesce(confidence, F.lit(UNSTATED))
    for kind, value in SOURCE_CONFIDENCE.items():
        out = F.when(source_kind == kind, F.lit(value)).otherwise(out)
    return out


def level(source_kind: Column, confidence: Column) -> Column:
    """fact for the owner's own values, else by confidence."""
    sure = sure_confidence(source_kind, confidence)
    out = F.when(source_kind == "human", "fact")
    for name, low in LEVELS:
        out = out.when(sure >= low - EPSILON, name)
    return out.otherwise("guess")


def at_least(floor: str, source_kind: Column, confidence: Column) -> Column:
    if floor == "fact":
        return source_kind == "human"
    lows = dict(LEVELS) | {"guess": 0.0}
    return sure_confidence(source_kind, confidence) >= lows[floor] - EPSILON


# --- rules that assign values --------------------------------------------------------


def apply_rules(messages: DataFrame, rules: list[dict], many: tuple[str, ...] = MANY) -> DataFrame:
    """(message_id, dimension, value, source_ref) that the rules assert, in one pass over the messages.

    A rule has id, version, priority, conditions and a dimension with a value.
    The first matching rule by (priority, id) wins a one-value dimension; in a
    many-value dimension each value counts once, from its first rule.
    """
    from archivolt.plans.conditions import rule_column

    ordered = sorted((r for r in rules if r.get("enabled", True)), key=lambda r: (r["priority"], r["id"]))
    out = None
    for dimension in dict.fromkeys(r["dimension"] for r in ordered):
        mine = [r for r in ordered if r["dimension"] == dimension]
        hit = [F.when(rule_column(r["conditions"]), F.struct(F.lit(r["value"]).alias("value"), F.lit(f"rule:{r['id']}@{r['version']}").alias("source_ref"))) for r in mine]
        if dimension in many:
            seen: dict[str, list[Column]] = {}
            for r, h in zip(mine, hit, strict=True):
                seen.setdefault(r["value"], []).append(h)
            found = F.explode(F.array_compact(F.array(*[F.coalesce(*hs) for hs in seen.values()])))
        else:
            found = F.coalesce(*hit)
        rows = messages.select(F.col("id").alias("message_id"), F.lit(dimension).alias("dimension"), found.alias("hit")).where("hit is not null")
        rows = rows.select("message_id", "dimension", "hit.value", "hit.source_ref")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no rule is enabled")
    return out


def merge_rule_values(current: DataFrame, made: DataFrame) -> DataFrame:
    """``current`` without earlier rule rows, with ``made`` where no human value stands in a one-value dimension."""
    kept = current.where(~F.coalesce(F.startswith("source_ref", F.lit("rule:")), F.lit(False)))
    human = kept.where("source_kind = 'human'").select("message_id", "dimension").distinct()
    fresh = made.join(human, ["message_id", "dimension"], "left_anti").withColumn("source_kind", F.lit("rule"))
    return kept.unionByName(fresh)
