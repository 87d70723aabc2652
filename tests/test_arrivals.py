"""Threads and components over any split into batches, and stateful streams over three files."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from archivolt.operators import graph
from archivolt.queries import ingest
from archivolt.streaming import jobs

MESSAGES = "id long, account string, message_id string, provider string, refs array<string>, received_at timestamp, arrived long"


def one_by_one(rows):
    thread, stored, by_provider = {}, [], {}
    for id_, account, message_id, provider, refs, received, arrived in sorted(rows, key=lambda r: r[6]):
        if provider is not None:
            found = by_provider.setdefault((account, provider), id_)
            thread[id_] = thread.get(found, id_)
        else:
            known = [(at is None, at or datetime.min, when, other) for other, acc, name, at, when in stored if acc == account and name in (refs or [])]
            thread[id_] = thread[min(known)[3]] if known else id_
        stored.append((id_, account, message_id, received, arrived))
    return thread


@pytest.mark.parametrize("seed", [1, 2])
def test_threads_are_those_of_one_by_one(spark, seed):
    draw = random.Random(seed)
    rows = []
    for i in range(120):
        refs = draw.choice([None, [], [f"<{draw.randrange(70)}>" for _ in range(draw.randint(1, 3))]])
        received = draw.choice([None, datetime(2024, 1, 1) + timedelta(hours=draw.randrange(30))])
        rows.append((i, draw.choice("ab"), draw.choice([None, f"<{draw.randrange(70)}>"]), draw.choice([None, None, f"p{draw.randrange(9)}"]), refs, received, draw.randrange(10**6) * 1000 + i))
    rows += [(1000 + i, "c", f"<c{i}>", None, [f"<c{i - 1}>"], datetime(2024, 1, 1), 10**10 + i) for i in range(40)]  # a chain of answers
    rows.sort(key=lambda r: r[6])
    want = one_by_one(rows)
    frame = spark.createDataFrame(rows, MESSAGES)
    for cuts in ([0, 160], [0, 37, 90, 160]):
        stored = frame.drop("refs").withColumn("thread", F.col("id")).limit(0)
        for a, b in zip(cuts, cuts[1:]):
            batch = spark.createDataFrame(rows[a:b], MESSAGES)
            stored = graph.written(stored.unionByName(batch.drop("refs").join(graph.threads_on_arrival(batch, stored), "id")), "stored")
        assert {r["id"]: r["thread"] for r in stored.collect()} == want


def test_components_grow_by_any_batches(spark):
    draw = random.Random(5)
    edges = [(draw.randrange(90), draw.randrange(90)) for _ in range(60)] + [(None, 3), (7, 7)]
    frame = spark.createDataFrame(edges, "a long, b long")
    want = {r["id"]: r["root"] for r in graph.connected(frame).collect()}
    for size in (62, 21, 9):
        labels = frame.select(F.col("a").alias("id"), F.col("a").alias("root")).limit(0)
        for k in range(0, len(edges), size):
            labels = graph.written(graph.extended(labels, spark.createDataFrame(edges[k : k + size], "a long, b long")), "labels")
        assert {r["id"]: r["root"] for r in labels.collect()} == want


def drained(spark, tmp_path, name, files, make, schema):
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}/in")
        jobs.to_parquet(make(jobs.event_stream(spark, f"{tmp_path}/{name}/in", spark.createDataFrame([], schema).schema, files=100)), f"{tmp_path}/{name}/out", f"{tmp_path}/{name}/run").awaitTermination(180)
    return sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/{name}/out").collect())


def test_capped_windows_in_state_over_three_files(spark, tmp_path):
    draw, start = random.Random(3), datetime(2024, 1, 1)
    rows = sorted((start + timedelta(minutes=draw.randrange(6000)), f"u{draw.randrange(4)}", i) for i in range(240))
    rows = [(u, i, t) for t, u, i in rows]
    schema = "user string, id long, ts timestamp"
    make = lambda stream: jobs.capped_windows(stream, key="user", at="ts", id_="id", gap=3600, cap=4)
    want = []
    for user in {r[0] for r in rows}:
        last = first = None
        for u, i, t in sorted((r for r in rows if r[0] == user), key=lambda r: (r[2], r[1])):
            if last is None or t - last > timedelta(hours=1):
                first, n = str(i), 0
            want.append((user, i, first, n // 4))
            last, n = t, n + 1
    cut = [k for k in range(60, 240) if rows[k][2] > rows[k - 1][2]]  # rows of one moment stay in one file
    a, b = cut[0], next(k for k in cut if k >= 150)
    assert drained(spark, tmp_path, "three", [rows[:a], rows[a:b], rows[b:]], make, schema) == sorted(want)
    assert drained(spark, tmp_path, "one", [rows], make, schema) == sorted(want)


def test_silent_services_over_three_files(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [("a", start), ("b", start), ("b", start + timedelta(minutes=30)), ("c", start + timedelta(minutes=60)), ("d", start + timedelta(minutes=90)), ("d", start + timedelta(minutes=120))]
    make = lambda stream: jobs.silences(stream, every=300, grace=900)
    got = drained(spark, tmp_path, "silent", [rows[:3], rows[3:4], rows[4:]], make, "service string, ts timestamp")
    # a and b are down by the second file's mark at the latest, c is down when the last ends; d checks in again
    assert {(s, status) for s, _, status in got if status == "down"} == {("a", "down"), ("b", "down"), ("c", "down")}


@pytest.mark.parametrize("shift", ["interval 31 day", "interval '-3 microsecond'", "interval 0 second"])
def test_windows_in_state_over_months_and_microseconds(spark, tmp_path, shift):
    """Rows of a second month came late and were dropped; rows of one millisecond went by id, not by time."""
    con = duckdb.connect()
    source = "(select * from '/root/testdata/sf0.001/events.parquet'), range(3) r(i)"
    con.execute(f"copy (select event_id + i * 1000000 as event_id, (ts + i * {shift})::timestamp as ts, user_id, event_type, value, props from {source}) to '{tmp_path}/events.parquet'")
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    want = con.execute(ingest.registry.oracles["t3_windows_in_state"])
    columns = [d[0] for d in want.description]
    got = ingest.registry.queries["t3_windows_in_state"](spark, str(tmp_path)).select(*columns)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want.fetchall())


def test_threads_that_are_told_leave_the_walk(spark, monkeypatch):
    """Rounds write what still waits, not every message again."""
    at = datetime(2024, 1, 1)
    rows = [(i, "a", f"<a{i}>", None, [], at, i) for i in range(200)]
    rows += [(1000 + i, "c", f"<c{i}>", None, [f"<c{i - 1}>"], at, 1000 + i) for i in range(40)]
    counts, write = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: (made := write(df, name), counts.append((name, made.count())))[0])
    batch = spark.createDataFrame(rows, MESSAGES)
    got = graph.threads_on_arrival(batch, batch.drop("refs").withColumn("thread", F.col("id")).limit(0))
    assert {r["id"]: r["thread"] for r in got.collect()} == one_by_one(rows)
    sizes = [n for _, n in counts]
    assert sizes[:2] == [240, 240] and max(sizes[2:]) < 40
