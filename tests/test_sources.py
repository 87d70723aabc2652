"""Calendar files, notes, silences, remembered tables, answer keys and imports on small rows."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from archivolt.functions import text as X
from archivolt.operators import cases, export, imports
from archivolt.sources import calendar, notes
from archivolt.streaming import jobs

ICS = """BEGIN:VCALENDAR\r
BEGIN:VEVENT\r
UID:a\r
SUMMARY:Plan\\, long\r
  er\r
DTSTART;TZID=Europe/Stockholm:20240701T100000\r
DTEND;TZID=Europe/Stockholm:20240701T110000\r
END:VEVENT\r
BEGIN:VEVENT\r
UID:b\r
DTSTART;VALUE=DATE:20240702\r
TRANSP:TRANSPARENT\r
END:VEVENT\r
BEGIN:VEVENT\r
UID:a\r
SEQUENCE:2\r
SUMMARY:Moved\r
DTSTART:20240703T080000Z\r
STATUS:CANCELLED\r
END:VEVENT\r
BEGIN:VEVENT\r
SUMMARY:no uid\r
DTSTART:20240703T080000Z\r
END:VEVENT\r
END:VCALENDAR\r
"""


def test_calendar_entries(spark, tmp_path):
    (tmp_path / "a.ics").write_text(ICS, newline="")
    rows = {r["uid"]: r for r in calendar.read(spark, str(tmp_path)).withColumn("s", F.col("starts_at").cast("string")).withColumn("e", F.col("ends_at").cast("string")).collect()}
    assert sorted(rows) == ["a", "b"]
    assert (rows["a"]["summary"], rows["a"]["s"], rows["a"]["e"], rows["a"]["show_as"]) == ("Moved", "2024-07-03 08:00:00", "2024-07-03 08:00:00", "cancelled")
    assert (rows["b"]["s"], rows["b"]["e"], rows["b"]["all_day"], rows["b"]["show_as"]) == ("2024-07-02 00:00:00", "2024-07-03 00:00:00", True, "free")
    first = calendar.entries(spark.createDataFrame([(ICS.replace("SEQUENCE:2", "SEQUENCE:-1"),), (None,)], "text string")).where("uid = 'a'").withColumn("s", F.col("starts_at").cast("string")).first()
    assert (first["summary"], first["s"]) == ("Plan, long er", "2024-07-01 08:00:00")


def test_notes(spark, tmp_path):
    (tmp_path / "n.md").write_text("---\nuid: 7\ntitle: \"A: b\"\nuid: 8\n---\nBody\n## One\nfirst\n## Two\n")
    (tmp_path / "plain.md").write_text("no head\n")
    made = {r["path"].rsplit("/", 1)[1]: r for r in notes.parsed(notes.read(spark, str(tmp_path))).collect()}
    assert made["n.md"]["fields"] == {"title": "A: b", "uid": "8"} and made["n.md"]["body"].startswith("Body")
    assert made["plain.md"]["fields"] == {} and made["plain.md"]["body"] == "no head\n"
    cut = notes.sections(spark.createDataFrame([("p", "intro\n## One\nfirst\n\nmore\n## Two\n### deep\n"), ("q", None)], "path string, text string")).orderBy("ordinal").collect()
    assert [(r["heading"], r["body"]) for r in cut] == [(None, "intro"), ("One", "first\n\nmore"), ("Two", "### deep")]
    was = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, fingerprint string")
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "path string, fingerprint string")
    assert {r["path"]: r["change"] for r in notes.changes(was, now).collect()} == {"a": "unchanged", "b": "changed", "c": "gone", "d": "new"}


def test_silences_by_watermark(spark, tmp_path):
    t = datetime(2024, 1, 1)
    # "a" stops at once; "b" goes on and moves the watermark past a's late, then past its down time
    files = [[("a", 0), ("b", 0)], [("b", 12)], [("b", 13)], [("b", 30)], [("b", 31)], [("b", 32)]]
    for i, rows in enumerate(files):
        spark.createDataFrame([(s, t + timedelta(minutes=m)) for s, m in rows], "service string, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema("service string, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    jobs.to_parquet(jobs.silences(stream, every=300, grace=300), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(120)
    told = [(r["service"], r["status"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert sorted(x for x in told if x[0] == "a") == [("a", "down"), ("a", "late")]


def test_remembered_tables(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "id long, v string")
    stamp = export.fingerprint(rows)
    assert stamp == export.fingerprint(rows.orderBy(F.desc("id"))) != export.fingerprint(rows.distinct())
    asked = []

    def make():
        asked.append(1)
        return rows.groupBy("id").count()

    for _ in range(2):
        assert export.remembered(spark, str(tmp_path), stamp, make).count() == 2
    assert len(asked) == 1


def test_occurrences_of_a_series_stay_apart(spark):
    event = lambda *lines: "BEGIN:VEVENT\r\nUID:s\r\n" + "\r\n".join(lines) + "\r\nEND:VEVENT\r\n"
    text = event("DTSTART:20240701T100000Z", "SUMMARY:series") + event("RECURRENCE-ID:20240708T100000Z", "DTSTART:20240708T100000Z") + event("RECURRENCE-ID;TZID=Europe/Stockholm:20240715T120000", "DTSTART:20240715T150000Z", "SEQUENCE:2", "SUMMARY:moved") + event("RECURRENCE-ID:20240715T100000Z", "DTSTART:20240715T100000Z")
    got = {(r["occurrence"] and r["occurrence"].isoformat(), r["summary"]) for r in calendar.entries(spark.createDataFrame([(text,), (text,)], "text string")).collect()}
    assert got == {(None, "series"), ("2024-07-08T10:00:00", None), ("2024-07-15T10:00:00", "moved")}


def test_quotas_give_a_shortfall_to_the_stratum_first():
    shares = {"m": {"big": 2.0, "tail": 1.0}, "p": {"new": 1.0}}
    assert cases.quotas({"big": 100, "tail": 100, "new": 100}, shares, 8) == {"big": 4, "tail": 2, "new": 2}
    assert cases.quotas({"big": 1, "tail": 100, "new": 100}, shares, 8) == {"big": 1, "tail": 5, "new": 2}
    assert cases.quotas({"big": 1, "tail": 2, "new": 100}, shares, 8) == {"big": 1, "tail": 2, "new": 5}
    assert sum(cases.quotas({"big": 1}, shares, 8).values()) == 1


def test_answer_key_claims(spark):
    pool = spark.createDataFrame([(i, "g", i % 3 if i < 9 else None, None) for i in range(12)], "id long, group string, thread long, pattern string")
    drawn = cases.answer_key(pool, ["thread", "pattern"], {"s": {"g": 1.0}}, 50).collect()
    assert len(drawn) == 6 and sum(r["id"] >= 9 for r in drawn) == 3
    assert cases.answer_key(pool.limit(0), ["thread"], {"s": {"g": 1.0}}, 5).count() == 0


def test_middles_match_a_sort(spark):
    rows = [(i, k, None if i % 5 == 0 else datetime(2024, 1, 1) + timedelta(hours=(i * 37) % 90)) for k, n in (("a", 1), ("b", 2), ("c", 31), ("d", 40)) for i in range(n)]
    got = {r["k"]: r["id"] for r in cases.middles(spark.createDataFrame(rows, "id long, k string, received_at timestamp"), "k").collect()}
    for key in "abcd":
        mine = sorted((x for x in rows if x[1] == key), key=lambda x: (x[2] is not None, x[2] or datetime.min, x[0]))
        assert got[key] == mine[(len(mine) + 1) // 2 - 1][0]


@pytest.mark.parametrize("key", ["", "one", "hello world", "faktura # från", "# done", "a b c", "fwd hello world"])
def test_skeleton_patterns_match_exactly_their_skeletons(spark, key):
    subjects = [None, "", " - ", "One", "one!", "Re: ONE", "re[2]: sv (3): one", "one two", "hello, world!", "hello - world", "hello world more", "hello", "SV: Faktura 2026-09 från Telia", "faktura 1 2 3 från", "faktura från", "12 34 a5 done", "# done",
                "done", "a b c d", "a b", "(a) b, c", "re: re: a b c", "Re[2]: (Fwd) hello, world!", "a b cd", "oneone"]
    rows = spark.createDataFrame([(s,) for s in subjects], "s string")
    found = rows.select("s", (X.skeleton(F.col("s")) == key).alias("want"), F.rlike(F.coalesce("s", F.lit("")), F.lit(X.skeleton_regex(key))).alias("got")).where("want <> got").collect()
    assert not found


def test_imports_take_empty_files(spark):
    lines = spark.createDataFrame([], "item long, labels map<string,string>, unsure array<string>")
    items, allowed = spark.createDataFrame([(1,)], "item long"), spark.createDataFrame([("topic", "a")], "field string, value string")
    assert imports.label_problems(lines, items, allowed, ["topic"]).isEmpty()
    bare = spark.createDataFrame([(1, None, None)], lines.schema)
    assert [(r["field"], r["problem"]) for r in imports.label_problems(bare, items, allowed, ["topic"]).collect()] == [("topic", "missing")]
