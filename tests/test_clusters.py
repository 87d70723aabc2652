"""Clusters of machine mail on rows made for them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from archivolt.operators import clusters as C

SCHEMA = "id long, account string, sender string, name string, subject string, received_at timestamp, kind string, type string, target string, olds array<string>, in_inbox boolean"
OLD, NEW = datetime(2020, 1, 1), datetime(2024, 5, 1)


def mail(i, sender, subject, at=NEW, account="a", olds=("X",), inbox=True, name="N", kind="k"):
    return (i, account, sender, name, subject, at, kind, None, None, list(olds) if olds is not None else None, inbox)


def test_shared_senders_are_split_before_counting(spark):
    rows = [mail(i, "robot", s) for i, s in enumerate(["[A] one", "[A] two", "[B] x", "plain words", "server Down!"] * 3)]
    rows += [mail(100 + i, "letter", s) for i, s in enumerate(["Du", "Vad", "Hej", "[Only] tag"] * 4)]
    rows += [mail(200, None, "x")] + [mail(300 + i, "few", "[A] x" if i else "[B] y") for i in range(11)]
    got = {(r["sender"], r["system"]): r["n"] for r in C.clusters(spark.createDataFrame(rows, SCHEMA), now="2024-06-01", least=1).collect()}
    assert got == {("robot", "[A]"): 6, ("robot", "[B]"): 3, ("robot", "plain"): 3, ("robot", "… Down!"): 3, ("letter", None): 16, ("few", "[A]"): 10, ("few", "[B]"): 1}


def test_state_places_and_subjects(spark):
    rows = [mail(1, "s", "Re: b", OLD, olds=None, inbox=None), mail(2, "s", "b", OLD, olds=["X", "Y", "\\Sent"]), mail(3, "s", "a", OLD, name="M", kind=None), mail(4, "s", None, None), mail(5, "s", "c", datetime(2019, 1, 1), name="M")]
    rows += [mail(10 + i, "t", "x", NEW) for i in range(12)] + [mail(30 + i, "q", "x", NEW, account="b") for i in range(3)]
    found = C.clusters(spark.createDataFrame(rows, SCHEMA), now="2024-06-01", least=2)
    got = {r["sender"]: r for r in found.collect()}
    s = got["s"]
    assert (s["status"], s["n"], s["last_year"], s["in_inbox"], s["name"]) == ("dead", 5, 0, 4, "N")
    assert [tuple(p) for p in s["places"]] == [("X", 4), (C.GONE, 1), ("Y", 1)] and [tuple(k) for k in s["kinds"]] == [("k", 4), ("(none)", 1)]
    assert s["examples"] == ["", "a"]  # a message without a time is the newest; of equal times the later id
    assert (got["t"]["status"], got["q"]["status"]) == ("active", "quiet")
    told = {r["account"]: tuple(r)[1:] for r in C.summary(found, spark.createDataFrame(rows, SCHEMA).select("account", "in_inbox")).collect()}
    assert told == {"a": (1, 5, 4, 16, 12), "b": (0, 0, 0, 3, 3)}


def test_empty_and_small(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert C.clusters(none, now="2024-06-01").count() == 0
    assert C.clusters(spark.createDataFrame([mail(1, "s", "x")], SCHEMA), now="2024-06-01").count() == 0


def test_messages_are_worked_out_once(spark):
    """However many counts are made of them."""
    seen = spark.sparkContext.accumulator(0)
    told = F.udf(lambda s: (seen.add(1), s)[1], "string").asNondeterministic()
    rows = spark.createDataFrame([mail(i, "s", "x") for i in range(30)], SCHEMA).withColumn("sender", told("sender"))
    assert [r["n"] for r in C.clusters(rows, now="2024-06-01", least=1).collect()] == [30]
    assert seen.value == 30
