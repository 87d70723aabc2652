"""Drafted rules on rows made for them."""

from __future__ import annotations

from pyspark.sql import functions as F

from archivolt.operators import suggestions as S
from archivolt.plans.conditions import rule_column

MESSAGE = "id long, medium string, direction string, from_address string, subject string"
VALUE = "message_id long, dimension string, value string, source_kind string"


def made(spark, mails, given, least=2):
    messages = spark.createDataFrame(mails, MESSAGE)
    rows = S.accepted(messages, spark.createDataFrame(given, VALUE), ["topic"], least=least)
    return messages, rows, S.suggestions(rows, least=least)


MAILS = [(i, "email", "in", who, subject) for i, (who, subject) in enumerate([("one", "a"), ("one", "b"), ("two", "Invoice 7"), ("two", "Invoice 8"), ("two", "Hello you"), ("two", "Hello you"), ("few", "x"), ("ruled", "x"), ("ruled", "x"), ("out", "x"), ("one", "c")])]
MAILS += [(20, "teams_chat", "in", "one", "a"), (21, "email", "out", "one", "a"), (22, "email", "in", None, "a")]
GIVEN = [(0, "topic", "A", "human"), (1, "topic", "A", "model"), (2, "topic", "B", "human"), (3, "topic", "B", "human"), (4, "topic", "C", "human"), (5, "topic", "D", "human"), (6, "topic", "A", "human"), (7, "topic", "A", "rule"), (8, "topic", "A", "import"), (0, "other", "A", "human")]


def test_senders_whole_or_by_templates(spark):
    _, _, found = made(spark, MAILS, GIVEN)
    assert {tuple(r) for r in found.collect()} == {("topic", "A", "one", None, 2), ("topic", "B", "two", "invoice #", 2)}


def test_tree_group_rules_and_preview(spark):
    messages, rows, found = made(spark, MAILS, GIVEN)
    nodes = {tuple(r)[:3]: tuple(r)[3:] for r in S.tree(found, F.lit("all")).collect()}
    assert nodes == {("topic", None, None): (2, 4), ("topic", "all", None): (2, 4), ("topic", "all", "A"): (1, 2), ("topic", "all", "B"): (1, 2)}
    rules = {r["value"]: (r["members"], r["senders"], [tuple(p) for p in r["pairs"]]) for r in S.group_rules(found).collect()}
    assert rules == {"A": (1, ["one"], []), "B": (1, [], [("two", "invoice #")])}
    seen = {r["value"]: (r["matched"], r["conflicting"]) for r in S.preview(found, messages, rows).collect()}
    assert seen == {"A": (3, 0), "B": (2, 0)}
    condition = S.as_conditions(["one"], [("two", "invoice #")])
    got = messages.withColumn("from_name", F.lit("")).where("medium = 'email' and direction = 'in'")
    assert sorted(r["id"] for r in got.where(rule_column(condition)).collect()) == [0, 1, 2, 3, 10]


def test_empty_tables(spark):
    messages, rows, found = made(spark, [], [])
    assert found.count() == S.tree(found, F.lit("x")).count() == S.group_rules(found).count() == S.preview(found, messages, rows).count() == 0
