"""Decisions from model probabilities: routing, agreement, acceptance, lifts, evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from archivolt.operators import graph

# The thresholds of a decision.
ONE_MIN, ONE_MARGIN, MANY_MIN = 0.70, 0.15, 0.5
EPSILON = 1e-9
#: Verdicts and agreement that lift a group's answers.
LIFT_MIN, LIFT_FLOOR = 12, 0.85


def ranked(scores: Column) -> Column:
    """(probability, value) of a score map, best first; ties by value."""
    rows = F.transform(F.map_entries(scores), lambda e: F.struct((-e["value"]).alias("p"), e["key"].alias("value")))
    return F.sort_array(rows)


def route_one(scores: Column, least: float = ONE_MIN, margin: float = ONE_MARGIN) -> Column:
    """(top, confidence, margin, decided): the best value, decided when it is likely and leads clearly."""
    order = ranked(scores)
    top, second = F.get(order, F.lit(0)), F.get(order, F.lit(1))
    lead = F.round(-top["p"] - F.coalesce(-second["p"], F.lit(0.0)), 6)
    decided = F.coalesce((-top["p"] >= least - EPSILON) & (lead >= margin - EPSILON), F.lit(False))
    return F.struct(top["value"].alias("top"), (-top["p"]).alias("confidence"), lead.alias("margin"), decided.alias("decided"))


def route_many(scores: Column, least: float = MANY_MIN) -> Column:
    """(selected, confidence): every value that is likely enough; as sure as the least clear one."""
    chosen = F.sort_array(F.map_keys(F.map_filter(scores, lambda k, v: v >= least - EPSILON)))
    clear = F.round(F.array_min(F.transform(F.map_values(scores), lambda v: F.greatest(v, 1 - v))), 6)
    return F.struct(chosen.alias("selected"), clear.alias("confidence"))


def gates(origin: Column, topic: Column, ask_selected: Column, route_selected: Column, ask_origins: tuple[str, ...] = ("person", "person_via_system", "list"), work: str = "Work/") -> Column:
    """Names of the cross-field gates that empty a field."""
    return F.array_compact(
        F.array(
            F.when(ask_selected & ~F.coalesce(origin.isin(*ask_origins), F.lit(False)), "ask:origin"),
            F.when(route_selected & (origin == "auto_reply"), "route:auto_reply"),
            F.when(route_selected & ~F.coalesce(F.startswith(topic, F.lit(work)), F.lit(False)), "route:topic"),
        )
    )


def agreed(samples: DataFrame, unit: list[str], answer: str, confidence: str) -> DataFrame:
    """(unit, answer, confidence, samples): units whose samples all give the same answer, as sure as the weakest."""
    made = samples.groupBy(*unit).agg(F.min(answer).alias(answer), F.max(answer).alias("__most"), F.min(confidence).alias(confidence), F.count("*").alias("samples"), F.count(answer).alias("__answered"))
    return made.where((F.col(answer) == F.col("__most")) & (F.col("samples") == F.col("__answered"))).drop("__most", "__answered")


def accept(answers: DataFrame, thresholds: dict[str, float], effective: DataFrame) -> DataFrame:
    """``answers`` (message_id, field, value, confidence) with ``status``.

    Active at the field's threshold where no human value stands, superseded where
    one does, else proposed.  Fields without a threshold are never accepted.
    """
    human = effective.where("source_kind = 'human'").select("message_id", F.col("dimension").alias("field"), F.lit(True).alias("__human"))
    floors = F.create_map(*[F.lit(x) for pair in sorted(thresholds.items()) for x in pair])
    joined = answers.join(human.distinct(), ["message_id", "field"], "left")
    status = F.when(F.col("__human"), "superseded").when(F.col("confidence") >= floors[F.col("field")] - EPSILON, "active").otherwise("proposed")
    return joined.withColumn("status", status).drop("__human")


def lifts(verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, agreed, n, bound, lifted) of boolean verdicts ``ok``."""
    from archivolt.functions.text import wilson_lower

    made = verdicts.groupBy(*keys).agg(F.count_if("ok").alias("agreed"), F.count("*").alias("n"))
    bound = wilson_lower(F.col("agreed"), F.col("n"))
    return made.withColumn("bound", bound).withColumn("lifted", (F.col("n") >= LIFT_MIN) & (bound >= LIFT_FLOOR - EPSILON))


def latest_answers(answers: DataFrame, unit: list[str], order: list[str]) -> DataFrame:
    """The newest answer of each unit."""
    ranked_ = Window.partitionBy(*unit).orderBy(*[F.desc(o) for o in order])
    return answers.withColumn("__rn", F.row_number().over(ranked_)).where("__rn = 1").drop("__rn")


def ask_plan(units: DataFrame, answered: DataFrame, cost: str, budget: float, order: list[str]) -> DataFrame:
    """``units`` with ``step``: reuse, ask or trimmed (beyond the budget, in order).

    The running cost is summed per block of rows first, so no task holds all units.
    """
    known = answered.select("unit").distinct().withColumn("__known", F.lit(True))
    rows = units.join(known, "unit", "left")
    asked = rows.where("__known is null").withColumn("__block", F.floor(F.col(order[0]) / 1000))
    totals = asked.groupBy("__block").agg(F.sum(cost).alias("__sum"))
    before = totals.select("__block", F.coalesce(F.sum("__sum").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("__before"))
    within = Window.partitionBy("__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    spent = asked.join(before, "__block").withColumn("__spent", F.sum(cost).over(within) + F.col("__before"))
    steps = spent.select("unit", F.when(F.col("__spent") <= budget, "ask").otherwise("trimmed").alias("step"))
    return rows.where("__known").select("unit", F.lit("reuse").alias("step")).unionByName(steps)


# --- evaluation -----------------------------------------------------------------------


def compare(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(value, labelled, predicted, correct, precision, recall) of one-value answers (item, value)."""
    joined = gold.select("item", F.col("value").alias("gold")).join(predicted.select("item", F.col("value").alias("guess")), "item")
    right = F.col("gold") == F.col("guess")
    by_guess = joined.groupBy(F.col("guess").alias("value")).agg(F.count("*").alias("predicted"), F.count_if(right).alias("correct"))
    by_gold = gold.groupBy("value").agg(F.count("*").alias("labelled"))
    both = by_gold.join(by_guess, "value", "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return both.select(
        "value",
        zero("labelled").alias("labelled"),
        zero("predicted").alias("predicted"),
        zero("correct").alias("correct"),
        (zero("correct") / F.when(F.col("predicted") > 0, F.col("predicted"))).alias("precision"),
        (zero("correct") / F.when(F.col("labelled") > 0, F.col("labelled"))).alias("recall"),
    )


def sweep(scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, decided, right) of rows (score, ok): one pass, a column pair per threshold."""
    sums = [F.struct(F.lit(t).alias("threshold"), F.count_if(F.col("score") >= t - EPSILON).alias("decided"), F.count_if((F.col("score") >= t - EPSILON) & F.col("ok")).alias("right")) for t in thresholds]
    return scored.agg(F.array(*sums).alias("rows")).select(F.inline("rows"))


def agreement(labels: DataFrame) -> DataFrame:
    """(a, b, both, same) of labellers that labelled the same items (item, labeller, value)."""
    left, right = labels.select("item", F.col("labeller").alias("a"), F.col("value").alias("va")), labels.select("item", F.col("labeller").alias("b"), F.col("value").alias("vb"))
    pairs = left.join(right, "item").where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("both"), F.count_if(F.col("va") == F.col("vb")).alias("same"))


def calibration(scored: DataFrame, buckets: int = 10) -> DataFrame:
    """(bucket, n, right, mean) of rows (score, ok)."""
    bucket = F.least(F.lit(buckets - 1), F.greatest(F.lit(0), F.floor(F.col("score") * buckets + 1e-6))).cast("long")
    return scored.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.count_if("ok").alias("right"), F.avg("score").alias("mean"))


#: Fixed value: the probability at which a boundary is decided.
BOUNDARY_LEAST = 0.90


def boundary(scores: Column, side_of: dict[str, str], least: float = BOUNDARY_LEAST) -> Column:
    """struct(side, probability, margin, decided): the scores summed by side; values without a side don't count, ties go by name."""
    sides = sorted(set(side_of.values()))
    total = {s: F.round(reduce(Column.__add__, [F.coalesce(scores[v], F.lit(0.0)) for v, t in side_of.items() if t == s]), 6) for s in sides}
    ranked = F.array_sort(F.array(*[F.struct((-total[s]).alias("p"), F.lit(s).alias("s")) for s in sides]))
    first, second = F.element_at(ranked, 1), F.coalesce(F.get(ranked, F.lit(1))["p"], F.lit(0.0))
    p = -first["p"]
    return F.struct(first["s"].alias("side"), p.alias("probability"), F.round(p + second, 6).alias("margin"), (p >= least - EPSILON).alias("decided"))


def confused(answers: DataFrame, *, most: int = 6) -> DataFrame:
    """(field, values, items): values of a field that are taken for one another, as classes.

    ``answers``: field, guess, gold.  The ``most`` frequent confusions of a field
    link its values; ties go by guess, then gold; ``items`` counts the answers of
    those links.
    """
    wrong = answers.where("guess <> gold").groupBy("field", "guess", "gold").agg(F.count("*").alias("n"))
    order = Window.partitionBy("field").orderBy(F.desc("n"), "guess", "gold")
    top = wrong.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= most)
    named = lambda c: F.concat_ws("\u0001", "field", c)
    root = graph.connected(top.select(named("guess").alias("a"), named("gold").alias("b")))
    linked = top.join(root, named("guess") == root["id"])
    values = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("guess", "gold")))))
    return linked.groupBy("field", "root").agg(values.alias("values"), F.sum("n").alias("items")).drop("root")
