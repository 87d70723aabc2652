"""Origin signals one by one, and who wins."""

from __future__ import annotations

from datetime import datetime

import pytest

from archivolt.operators import origins as O

MESSAGE = (
    "id long, account string, thread_id long, medium string, direction string, from_address string, from_name string, subject string, received_at timestamp, is_automated boolean, list_id string,"
    " list_unsubscribe string, precedence string, auto_submitted string, x_mailer string, reasons array<string>"
)
AT = datetime(2024, 1, 1)


def mail(id_, *, account="a", thread=None, medium="email", direction="in", sender="ann@x.example", name="", subject="hello", auto=False, list_id=None, unsubscribe=None, precedence=None, submitted=None, mailer=None, reasons=()):
    return (id_, account, thread, medium, direction, sender, name, subject, AT, auto, list_id, unsubscribe, precedence, submitted, mailer, list(reasons))


def told(spark, rows, people=(), events=(), types=(), ruled=()):
    frame = lambda data, schema: spark.createDataFrame(list(data), schema)
    found = O.origin(frame(rows, MESSAGE), frame(people, "message_id long, role string, address string"), frame(events, "message_id long, kind string, status string"), frame(types, "message_id long, value string"), frame(ruled, "id long"))
    return {r["id"]: (r["value"], r["signal"], r["verdict"]) for r in found.collect()}


CASES = {
    "quarantine": (mail(1, sender="Quarantine@eu.protection.outlook.com"), {"events": [(1, "alert", "x")]}, ("mail_system", "quarantine@1")),
    "report": (mail(1), {"events": [(1, "backup", "ok"), (1, "backup", "ok")]}, ("system_report", "event@2")),
    "alert": (mail(1), {"events": [(1, "backup", "ok"), (1, "backup", "failed")]}, ("alert", "event@2")),
    "type": (mail(1), {"types": [(1, "invoice")]}, ("transactional", "type@2")),
    "teams app": (mail(1, medium="teams_chat", auto=True), {}, ("notification", "teams_app@1")),
    "bulk": (mail(1, unsubscribe="<x>", precedence="Bulk"), {}, ("marketing", "bulk_mailer@1")),
    "mailer": (mail(1, unsubscribe="<x>", mailer="Create Send 2"), {}, ("marketing", "bulk_mailer@1")),
    "bounce": (mail(1, subject="Fördröjd leverans: x", reasons=["null-return-path"]), {}, ("mail_system", "bounce@2")),
    "daemon": (mail(1, sender="Postmaster@x.example"), {}, ("mail_system", "bounce@2")),
    "away": (mail(1, submitted="Auto-Replied"), {"types": [(1, "unknown")]}, ("auto_reply", "auto_reply@1")),
    "teams user": (mail(1, medium="teams_channel"), {}, ("person", "teams_user@1")),
    "via": (mail(1, name="Anna Berg (via Docs)"), {}, ("person_via_system", "via_name@1")),
}


@pytest.mark.parametrize("case", sorted(CASES))
def test_each_signal(spark, case):
    row, more, want = CASES[case]
    assert told(spark, [row], **more)[1] == (*want, "decided")


def test_what_is_no_signal(spark):
    rows = [mail(1), mail(2, name="NASA via X"), mail(3, unsubscribe="<x>", precedence="bulk", subject="Your receipt"), mail(4, unsubscribe="<x>"), mail(5, direction="out"), mail(6, sender=None, subject=None, name=None)]
    assert told(spark, rows) == {i: (None, None, "undecided") for i in (1, 2, 3, 4, 6)}


def test_persons_that_were_written_to(spark):
    out = [mail(90 + i, thread=7, direction="out", sender="me@x.example") for i in range(2)]
    to = [(90 + i, "to", "ann@x.example") for i in range(2)]
    rows = [mail(1, thread=7), mail(2), mail(3), mail(4, reasons=["precedence"]), *out]
    got = told(spark, rows, people=[*to, (3, "sender", "bot@y.example"), (1, "sender", "ann@x.example")])
    assert got == {1: ("person", "thread_reply@1", "decided"), 2: ("person", "correspondent@1", "decided"), 3: ("person_via_system", "sender_header@1", "decided"), 4: (None, None, "undecided")}
    many = [*rows, *(mail(20 + i, thread=20 + i) for i in range(3))]  # the same subject in four threads is a machine's
    assert told(spark, many, people=to)[2][2] == "undecided"


def test_lists_conflicts_and_rules(spark):
    rows = [mail(i, sender=f"s{i % 3}@x.example", list_id="l") for i in range(6)] + [mail(10, sender="one@x.example", list_id="m")]
    got = told(spark, rows)
    assert {got[i] for i in range(6)} == {("list", "mailing_list@1", "decided")} and got[10][2] == "undecided"
    both = [mail(1, medium="teams_chat"), mail(2, medium="teams_chat")]
    assert told(spark, both, types=[(1, "newsletter"), (2, "newsletter")], ruled=[(2,)]) == {1: (None, None, "conflict")}
    assert told(spark, []) == {}
