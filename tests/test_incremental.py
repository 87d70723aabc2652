"""The incremental plan on units made for it, and its budget."""

from __future__ import annotations

import random
from datetime import datetime

from pyspark.sql import functions as F

from archivolt.operators import incremental as I

T0, T1, T2 = datetime(2024, 1, 1), datetime(2024, 2, 1), datetime(2024, 3, 1)
CASES = "unit string, run string, run_at timestamp, sample int, members array<long>, made_at timestamp, full boolean"
ANSWERS = "unit string, run string, run_at timestamp, sample int, field string, value string, confidence double, fixed boolean"
FIELDS = {stage: ["a", "b"] for stage in I.STAGES}


def answers(unit, samples, run="r1", at=T1, fields=("a", "b"), value="x", confidence=0.5, fixed=False):
    return [(unit, run, at, s, f, value, confidence, fixed) for s in samples for f in fields]


def test_steps(spark):
    cases = [(u, "r1", T1, s, [1, 2], T1, True) for u, samples in (("agree", (0, 1, 2)), ("split", (0, 1, 2)), ("fixed", (0, 1, 2)), ("two", (0, 1)), ("quiet", (0,)), ("busy", (0,)), ("open", (0,)), ("moved", (0,))) for s in samples]
    cases += [("focus", "r1", T1, 0, [1], T1, False)]
    given = answers("agree", (0, 1)) + answers("agree", (2,), confidence=0.1) + answers("split", (0, 1)) + answers("split", (2,), value="y") + answers("two", (0, 1)) + answers("quiet", (0,)) + answers("busy", (0,)) + answers("open", (0,), fields=("a",)) + answers("moved", (0,)) + answers("focus", (0,))
    given += answers("fixed", (0, 1), value="x") + answers("fixed", (2,), value="z", fixed=True)
    # a later run settles the split sample; an earlier one doesn't count
    given += answers("split", (2,), run="r0", at=T0, value="x")
    new = [(100 + i, stage, unit, T2, grouped) for i, (stage, unit, grouped) in enumerate([("machine", "agree", False), ("machine", "split", False), ("machine", "split", True), ("machine", "fixed", True), ("machine", "two", True), ("machine", "fresh", False), ("machine", "tail", False), ("person", "quiet", False), ("person", "busy", False), ("person", "open", False), ("person", "focus", False), ("chat", "moved", False), ("chat", "first", False), ("chat", None, False), ("person", "stuck", False)])]
    stored = [(i, "fresh", T0) for i in (11, 12, 13)] + [(14, "tail", T0), (1, "quiet", T0), (21, "quiet", T2), (22, "quiet", T2)] + [(30 + k, "busy", T2) for k in range(3)] + [(1, "moved", T0), (2, "moved", T0), (41, "moved", T0), (42, "moved", T0), (43, "moved", T0)]
    failures = [("stuck",)] * 3 + [("fresh",)] * 2
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    plan = I.plan(frame(new, "id long, stage string, unit string, received_at timestamp, grouped boolean"), frame(stored, "id long, unit string, stored_at timestamp"), frame(cases, CASES), frame(given, ANSWERS), frame(failures, "unit string"), FIELDS)
    got = {r["unit"]: (r["step"], r["why"], r["cases"], [tuple(a) for a in r["answers"]] if r["answers"] else None) for r in plan.collect()}
    same = [("a", "x"), ("b", "x")]
    assert got == {
        "agree": ("reuse", None, 0, same), "split": ("ask", "template split", 1, None), "fixed": ("reuse", None, 0, [("a", "z"), ("b", "z")]), "two": ("covered", None, 0, None), "fresh": ("ask", "new template", 3, None), "tail": ("ask", "tail", 1, None),
        "quiet": ("reuse", None, 0, same), "busy": ("ask", "grown", 1, None), "open": ("ask", "grown", 1, None), "focus": ("ask", "new", 1, None), "moved": ("ask", "grown", 1, None), "first": ("ask", "new", 1, None), "stuck": ("given_up", "new", 0, None),
    }
    later = given + answers("split", (2,), run="r2", at=T2, value="x")
    again = I.plan(frame(new, "id long, stage string, unit string, received_at timestamp, grouped boolean"), frame(stored, "id long, unit string, stored_at timestamp"), frame(cases, CASES), frame(later, ANSWERS), frame(failures, "unit string"), FIELDS)
    assert again.where("unit = 'split'").first()["step"] == "reuse"


def test_budget_takes_whole_units_in_order(spark):
    draw = random.Random(6)
    for most in (0, 1, 7, 40, 1000):
        rows = [(draw.choice(I.STAGES), f"u{i}", draw.choice(["ask", "ask", "reuse"]), draw.choice([1, 1, 3, 5]), draw.choice([None, T0, T1, T2])) for i in range(60)]
        frame = spark.createDataFrame(rows, "stage string, unit string, step string, cases int, latest timestamp")
        order = sorted((r for r in rows if r[2] == "ask"), key=lambda r: (I.STAGES.index(r[0]), -(r[4] or datetime(1970, 1, 1)).timestamp(), r[1]))
        want, left = set(), most
        for stage, unit, _, cases, _ in order:
            if cases <= left:
                want.add((stage, unit))
                left -= cases
        assert {(r["stage"], r["unit"]) for r in I.trimmed(frame, most).collect()} == want


def test_empty_tables(spark):
    none = lambda schema: spark.createDataFrame([], schema)
    plan = I.plan(none("id long, stage string, unit string, received_at timestamp, grouped boolean"), none("id long, unit string, stored_at timestamp"), none(CASES), none(ANSWERS), none("unit string"), FIELDS)
    assert plan.count() == 0 and I.trimmed(plan, 5).count() == 0
    assert plan.withColumn("x", F.lit(1)).count() == 0
