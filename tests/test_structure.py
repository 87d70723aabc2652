"""The report over a placement on rows made for it."""

from __future__ import annotations

from pyspark.sql import functions as F

from archivolt.operators import structure as S

TARGETS = {"a": [S.Target("in", "Inbox", "inbox", [{"field": "kind", "in": ["x"]}]), S.Target("x", "T/x", "label", [{"field": "kind", "in": ["x", "y"]}, {"field": "n", "gt": 1}]), S.Target("l", "left", "leave", [{"field": "kind", "set": False}])], "empty": []}
ROWS = [(1, "a", "x", 5), (2, "a", "x", 0), (3, "a", "y", 2), (4, "a", None, None), (5, "empty", "x", 9), (6, "unknown", "x", 9), (7, "a", "x", 5)]
PLACES = [(1, "INBOX", None, "L", True), (3, "INBOX", "T/x", None, True), (3, "INBOX", None, "L", True), (4, "INBOX", None, "\\Sent", True), (5, "INBOX", None, None, True), (7, "INBOX", None, "L", False)]


def features(spark):
    rows = spark.createDataFrame(ROWS, "id long, account string, kind string, n int")
    return S.with_locations(rows, spark.createDataFrame(PLACES, "message_id long, folder string, folder_path string, label string, present boolean"))


def test_first_targets_and_the_inbox(spark):
    got = {r["id"]: (r["rule_id"], r["target"], r["leaves_inbox"]) for r in S.placed(features(spark), TARGETS).collect()}
    rest = (S.UNPLACED, S.TO_SORT)
    assert got == {1: ("in", "Inbox", False), 2: (*rest, False), 3: ("x", "T/x", True), 4: ("l", "left", False), 5: (*rest, True), 6: (*rest, False), 7: ("x", "T/x", False)}


def test_why_tells_every_condition(spark):
    got = {r["id"]: r["tests"] for r in S.why(features(spark), TARGETS).collect()}
    assert [(t["rule_id"], t["matched"], t["first"], [c["ok"] for c in t["conditions"]]) for t in got[1]] == [("in", True, True, [True, True]), ("x", True, False, [True, True]), ("l", False, False, [False])]
    assert got[1][0]["conditions"][0]["text"] == "in the inbox now" and got[1][1]["conditions"][1]["text"] == "n gt 1"
    assert [[c["ok"] for c in t["conditions"]] for t in got[4]] == [[True, False], [False, False], [True]]
    assert got[5] == [] and got[6] == []


def test_old_places_and_totals(spark):
    placed, old = S.placed(features(spark), TARGETS), {"a": {"L": "T/x"}}
    rows = {(r["account"], r["old"]): (r["n"], r["maps_to"], r["same"], [tuple(t) for t in r["targets"]]) for r in S.old_places(placed, old).collect()}
    assert rows[("a", "L")] == (2, "T/x", 1, [("Inbox", 1), ("T/x", 1)]) and ("a", "\\Sent") not in rows
    total = S.totals(placed, old).where("account = 'a'").first()
    assert (total["total"], total["inbox_before"], total["inbox_after"], total["to_sort"], total["left_alone"], total["same_place"]) == (5, 3, 2, 1, 1, 1)


def test_tree_examples_checklist_and_empty_tables(spark):
    placed = S.placed(features(spark), TARGETS).withColumn("received_at", F.lit(None).cast("timestamp"))
    nodes = {(r["account"], r["path"]): (r["leaf"], r["n"]) for r in S.tree(placed).collect()}
    assert nodes[("a", "T")] == (False, 2) and nodes[("a", "T/x")] == (True, 2)
    assert [r["id"] for r in S.examples(placed, "a", "T").collect()] == [3, 7]
    assert [r["id"] for r in S.examples(placed, "a", "T", rule="x", offset=1).collect()] == [7]
    ops = spark.createDataFrame([(7, "add_label", "T/x"), (7, "add_label", "T/x"), (3, "archive", None)], "message_id long, op string, label string")
    told = {(r["account"], r["step"], r["target"]): tuple(r)[3:] for r in S.checklist(placed, ops).collect()}
    assert told[("a", "label", "T/x")] == (2, 1, 1, 0) and told[("a", "archive", "")] == (1, 1, 1, 0)
    none = placed.limit(0)
    assert S.tree(none).count() == S.totals(none, {}).count() == S.checklist(none, ops).count() == S.old_places(none, {}).count() == 0
