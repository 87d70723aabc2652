"""What new messages need: answers of earlier cases given on, or a unit asked anew, within a budget.

A unit is a template of machine mail, a thread, or a window of a chat.  Its source
is the newest run that asked its full set; newer answers of single fields count
with it.  All of it is joins and grouping on the unit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

# Later messages that make a thread or window one to ask again, failures after which a unit is given up,
# samples of a template, and the order in which stages are asked.
GROWN, TRIES, SAMPLES = 3, 3, 3
STAGES = ("person", "chat", "machine")


def sources(cases: DataFrame) -> DataFrame:
    """(unit, run_at, run, made_at, members, samples): of each unit the newest run that asked its full set.

    ``cases``: unit, run, run_at, sample, members, made_at, full; ties between runs go to the later name.
    """
    newest = cases.where("full").groupBy("unit").agg(F.max(F.struct("run_at", "run")).alias("top")).select("unit", "top.*")
    mine = cases.where("full").join(newest, ["unit", "run_at", "run"])
    made = mine.groupBy("unit", "run_at", "run").agg(F.max("made_at").alias("made_at"), F.array_distinct(F.flatten(F.collect_list("members"))).alias("members"), F.array_sort(F.collect_set("sample")).alias("samples"))
    return made


def newest_answers(answers: DataFrame, source: DataFrame) -> DataFrame:
    """(unit, sample, field, value, confidence, fixed): the newest answer since a unit's source, its own included."""
    since = source.select("unit", F.col("run_at").alias("since"), F.col("run").alias("since_run"))
    later = answers.join(since, "unit").where(F.struct("run_at", "run") >= F.struct("since", "since_run"))
    best = later.groupBy("unit", "sample", "field").agg(F.max_by(F.struct("value", "confidence", "fixed"), F.struct("run_at", "run")).alias("a"))
    return best.select("unit", "sample", "field", "a.*")


def _needed(fields: list[str]):
    return F.size(F.array_except(F.array(*[F.lit(f) for f in fields]), F.collect_set("field"))) == 0


def agreed(newest: DataFrame, source: DataFrame, fields: list[str]) -> DataFrame:
    """(unit, answers): templates whose three samples agree on every field, with each field's least sure answer.

    A template lacks agreement if a sample is missing, an asked field is open in one,
    or the values of a field differ; a fixed answer stands whatever the others say.
    """
    full = [F.lit(i) for i in range(SAMPLES)]
    whole = newest.groupBy("unit", "sample").agg(_needed(fields).alias("whole")).groupBy("unit").agg(F.count_if("whole").alias("n"), F.array_sort(F.collect_set("sample")).alias("seen"))
    by_field = newest.groupBy("unit", "field").agg(
        F.count("*").alias("n"),
        F.count_distinct("value").alias("values"),
        F.bool_or("fixed").alias("fixed"),
        F.min_by("value", F.when(F.col("fixed"), F.struct(F.lit(-2.0).alias("c"), "sample")).otherwise(F.struct(F.coalesce("confidence", F.lit(-1.0)).alias("c"), "sample"))).alias("value"),
    )
    split = (F.col("n") < SAMPLES) | (~F.col("fixed") & (F.col("values") > 1))
    judged = by_field.groupBy("unit").agg(F.count_if(split).alias("splits"), F.array_sort(F.collect_list(F.struct("field", "value"))).alias("answers"))
    three = source.where(F.col("samples") == F.array(*full)).select("unit")
    return judged.join(whole.where((F.col("n") == SAMPLES) & (F.col("seen") == F.array(*full))).select("unit"), "unit").join(three, "unit").where("splits = 0").select("unit", "answers")


def complete(newest: DataFrame, fields: list[str]) -> DataFrame:
    """(unit, answers): units whose first sample has every asked field."""
    first = newest.where("sample = 0").groupBy("unit").agg(_needed(fields).alias("whole"), F.array_sort(F.collect_list(F.struct("field", "value"))).alias("answers"))
    return first.where("whole").select("unit", "answers")


def plan(candidates: DataFrame, stored: DataFrame, cases: DataFrame, answers: DataFrame, failures: DataFrame, fields: dict[str, list[str]]) -> DataFrame:
    """(stage, unit, step, why, new, cases, latest, answers): a row per unit with new messages.

    ``candidates``: id, stage, unit, received_at, grouped (the owner has answered for its
    sender).  ``stored``: id, unit, stored_at of all messages.  ``failures``: unit, a row a failed
    try.  Step ``reuse`` gives earlier answers on, ``covered`` leaves it at the owner's, ``ask`` has
    its number of cases, ``given_up`` failed too often.  Null units are left out; a
    template of fewer than three messages in all is asked as one case.
    """
    new = candidates.where("unit is not null").groupBy("stage", "unit").agg(F.count("*").alias("new"), F.count_if(~F.coalesce("grouped", F.lit(False))).alias("plain"), F.max("received_at").alias("latest"))
    source = sources(cases)
    newest = newest_answers(answers, source)
    machine = agreed(newest, source, fields["machine"]).select("unit", F.lit("machine").alias("stage"), "answers")
    for stage in ("person", "chat"):
        machine = machine.unionByName(complete(newest, fields[stage]).select("unit", F.lit(stage).alias("stage"), "answers"))
    known = source.select("unit", "made_at", "members")
    later = stored.join(known, "unit").groupBy("unit").agg(F.count_if(F.col("stored_at") > F.col("made_at")).alias("later"), F.count_if(~F.array_contains("members", F.col("id"))).alias("outside"))
    sizes = stored.where("unit is not null").groupBy("unit").agg(F.count("*").alias("size"))
    failed = failures.groupBy("unit").agg(F.count("*").alias("tries"))
    rows = new.join(known.select("unit", F.lit(True).alias("asked_before")), "unit", "left").join(machine, ["stage", "unit"], "left").join(later, "unit", "left").join(sizes, "unit", "left").join(failed, "unit", "left")
    before, answered = F.coalesce("asked_before", F.lit(False)), F.col("answers").isNotNull()
    grown = F.when(F.col("stage") == "person", F.coalesce("later", F.lit(0))).otherwise(F.coalesce("outside", F.lit(0)))
    template = F.col("stage") == "machine"
    reuse = F.when(template, answered).otherwise(before & answered & (grown < GROWN))
    stuck = F.coalesce(F.col("tries") >= TRIES, F.lit(False))
    step = F.when(reuse, "reuse").when(template & (F.col("plain") == 0), "covered").when(stuck, "given_up").otherwise("ask")
    why = F.when(template, F.when(before, "template split").when(F.col("size") >= SAMPLES, "new template").otherwise("tail")).otherwise(F.when(before, "grown").otherwise("new"))
    asked = F.when(template & ~before & (F.col("size") >= SAMPLES), SAMPLES).otherwise(1)
    named = rows.withColumns({"step": step, "why": why, "cases": asked})
    return named.select("stage", "unit", "step", F.when(F.col("step").isin("ask", "given_up"), F.col("why")).alias("why"), "new", F.when(F.col("step") == "ask", F.col("cases")).otherwise(0).alias("cases"), "latest", F.when(F.col("step") == "reuse", F.col("answers")).alias("answers"))


def trimmed(units: DataFrame, most: int) -> DataFrame:
    """The units to ask that fit ``most`` cases: whole ones in order of stage, newest and name; one that doesn't fit is passed over.

    A pass takes units in order until one doesn't fit; what is left of the budget is then below
    its size, so there are no more passes than sizes.  A pass reads at most as
    many rows as cases are left.
    """
    place = F.array_position(F.array(*[F.lit(s) for s in STAGES]), F.col("stage"))
    asked = units.where("step = 'ask'").select("stage", "unit", "cases", F.struct(place.alias("stage"), (-F.unix_micros(F.coalesce(F.col("latest").cast("timestamp"), F.lit("1970-01-01").cast("timestamp")))).alias("age"), "unit").alias("__order"))
    taken, behind, left = [], None, most
    while left > 0:
        rows = asked.where(F.col("cases") <= left)
        if behind is not None:
            rows = rows.where(F.col("__order") > F.struct(F.lit(behind["stage"]).cast("long").alias("stage"), F.lit(behind["age"]).alias("age"), F.lit(behind["unit"]).alias("unit")))
        found = rows.orderBy("__order").limit(left + 1).withColumn("__sum", F.sum("cases").over(W.Window.orderBy("__order"))).orderBy("__order").collect()
        fits = [r for r in found if r["__sum"] <= left]
        if not fits:
            break
        taken += [(r["stage"], r["unit"], r["cases"]) for r in fits]
        behind = fits[-1]["__order"]
        left -= fits[-1]["__sum"]
    return units.sparkSession.createDataFrame(taken, "stage string, unit string, cases int")
