"""Each list of discoveries on rows made for it."""

from __future__ import annotations

from datetime import datetime, timedelta

from archivolt.operators import discover as D

MESSAGE = "id long, account string, thread_id long, direction string, from_address string, from_name string, subject string, received_at timestamp, is_automated boolean"
NOW = datetime(2024, 7, 1)


def frame(spark, rows):
    return spark.createDataFrame([(i, "a", *r) for i, r in enumerate(rows)], MESSAGE)


def people(spark, rows):
    return spark.createDataFrame(rows, "message_id long, role string, address string")


def test_waiting(spark):
    ago = lambda d: NOW - timedelta(days=d)
    rows = frame(spark, [(1, "in", "x", None, "?", ago(9), False), (1, "in", "x", None, "?", ago(5), False), (2, "in", "x", None, "?", ago(5), False), (2, "out", "me", None, "", ago(4), False), (3, "in", "x", None, "?", ago(61), False), (4, "out", "me", None, "", ago(9), False), (4, "in", "x", None, "?", ago(3), False), (None, "in", "x", None, "?", ago(1), False), (5, "in", "x", None, "no", ago(1), False)])
    got = {r["thread_id"]: (r["id"], r["seconds"]) for r in D.waiting(rows, rows.where("subject = '?'").select("id"), now=str(NOW)).collect()}
    assert got == {1: (1, 5 * 86400), 4: (6, 3 * 86400)}


def test_renewals(spark):
    mail = lambda dom, year, month, subject="Avtalet förnyas": (None, "in", f"a@{dom}", None, subject, datetime(year, month, 3), False)
    rows = [mail("yearly", y, 8) for y in (2021, 2022)] + [mail("yearly", 2023, 3)] + [mail("once", 2023, 8)] + [mail("past", y, 6) for y in (2021, 2022)] + [mail("monthly", y, m) for y in (2022, 2023) for m in range(1, 9)] + [mail("old", y, 8) for y in (2015, 2016)] + [mail("mine", y, 8) for y in (2021, 2022)] + [mail("else", y, 8, "hello") for y in (2021, 2022)]
    got = {(r["domain"], r["month"]): (r["years"], r["n"], r["last_year"], r["until"]) for r in D.renewals(frame(spark, rows), ["mine"], now=str(NOW)).collect()}
    assert got == {("yearly", 8): (2, 2, 2022, 1)}


def test_without_binder(spark):
    rows = frame(spark, [(t, "out", "me", None, "", NOW - timedelta(days=5), False) for t in range(3)])
    to = people(spark, [(i, "to", f"p{i}@{d}") for i in range(3) for d in ("mail.acme.com", "named.se", "gmail.com", "mine.se", "ab.io")] + [(0, "cc", "x@two.se"), (1, "bcc", "x@two.se"), (2, "to", "broken")])
    binders = spark.createDataFrame([("About NAMED, and ab.",), (None,)], "text string")
    got = {r["domain"]: (r["threads"], r["people"]) for r in D.without_binder(rows, to, binders, ["mine.se"], now=str(NOW)).collect()}
    assert got == {"mail.acme.com": (3, 3), "ab.io": (3, 3)}  # a name of two letters is too short to be found in a text


def test_quiet_senders(spark):
    weekly = lambda who, last, n, auto=True: [(None, "in", who, None, "", NOW - timedelta(days=last + 7 * k), auto) for k in range(n)]
    rows = [*weekly("stopped", 60, 30), *weekly("writes", 8, 30), *weekly("soon", 20, 30), *weekly("rare", 60, 11), *weekly("gone", 200, 30), *weekly("person", 60, 30, False), *weekly("offers", 60, 30)]
    sent = frame(spark, rows)
    kinds = sent.where("from_address = 'offers'").selectExpr("id as message_id", "case when id % 2 = 0 then 'offer' else 'note' end as value")
    got = {r["address"]: r["a_year"] for r in D.quiet_senders(sent, kinds, now=str(NOW)).collect()}
    assert got == {"stopped": 30}


def test_new_people(spark):
    at = lambda d: NOW - timedelta(days=d)
    rows = [(None, "in", "new", None, "", at(9), False), (None, "in", "new", "Nina", "", at(3), False), (None, "in", "once", "O", "", at(3), False), (None, "in", "known", "K", "", at(90), False), (None, "in", "known", "K", "", at(3), False), (None, "in", "unanswered", "U", "", at(4), False), (None, "in", "unanswered", "U", "", at(3), False), (None, "out", "me", None, "", at(1), False)]
    to = people(spark, [(7, "to", "new"), (7, "cc", "once"), (7, "to", "known"), (0, "to", "unanswered")])
    assert [tuple(r) for r in D.new_people(frame(spark, rows), to, now=str(NOW)).collect()] == [("new", "Nina", at(9), 2)]


def test_empty_tables(spark):
    none, nobody = frame(spark, []), people(spark, [])
    assert D.waiting(none, none.select("id"), now=str(NOW)).count() == D.renewals(none, [], now=str(NOW)).count() == D.new_people(none, nobody, now=str(NOW)).count() == 0
