"""Parsed mail: the library's readings of every header, without its parser where a header is plain."""

from __future__ import annotations

import random
from email import headerregistry, policy

import pytest
from pyspark.sql import functions as F

from archivolt.sources import mail

VALUES = {
    "From": ["Ann Lee <ANN1@X.example>", "a@b", "<a@b.c>", '"Lee, Ann" <a@b.c>', "Ann  Lee <a@b.c>", "a@b, c@d", "=?utf-8?q?=C3=85sa_B?= <ASA@X.example>", "Ann (x) <a@b>", "a..b@c", ".a@b", "Ann Lee", "", "A. Lee <a@b.c>", "group: a@b, c@d;", "Åsa <å@b>", "a+b-c@d-e.f", "a@b,", "=?x?= <a@b>"],
    "Subject": ["Order 7", "  two  blanks ", "=?utf-8?b?w6XDpMO2?= x", "a =? b", "a\n b", "\tTab", "", "å", "a=b?", "x =?utf-8?q?a?= =?utf-8?q?b?="],
    "Message-ID": ["<1@x>", "<1@x> tail", "1@x", "<a.b@c.d>", "<a@[1.2.3.4]>", "", "<a b@c>"],
    "Date": ["01 Jul 2001 10:00:00 +0200", "Sun, 1 Jul 2001 10:00:00 -0000", "never", "", "01 Jul 1989 10:00:00 +0200", "1 Jul 01 10:00 GMT", "01 Jul 2001 25:00:00 +0200", "1 Jul 99 10:00:00 EST", "01 Jul 2001 10:00:00 +9999", "01  Jul  2001  10:00:00 +0000", "=?utf-8?q?01_Jul_2001_10:00:00_+0000?="],
    "References": ["<1@x> <2@x>", "<1@x>\n <2@x>", "", "a  b"],
    "Content-Type": ["text/plain; charset=utf-8", "text/html", "text/plain; charset=x-unknown", "nonsense"],
}
VALUES |= {"To": VALUES["From"], "Cc": VALUES["From"], "In-Reply-To": VALUES["Message-ID"]}


def _raw(values: dict[str, str]) -> bytes:
    return ("".join(f"{k}: {v}\n" for k, v in values.items()) + "\nbody å\n").encode("latin-1")


def test_headers_read_as_by_the_library(monkeypatch):
    draw = random.Random(7)
    cases = [_raw({k: v}) for k, vs in VALUES.items() for v in vs]
    cases += [_raw({k: draw.choice(v) for k, v in VALUES.items() if draw.random() < 0.8}) for _ in range(1500)]
    cases += [_raw({"To": a}).replace(b"\n\n", b"\nTo: " + b.encode("latin-1") + b"\n\n") for a in VALUES["To"] for b in VALUES["To"]]
    found = [mail.parse(c) for c in cases]
    monkeypatch.setattr(mail, "_POLICY", policy.default)
    monkeypatch.setattr(mail, "_people", mail.getaddresses)
    for case, made in zip(cases, found, strict=True):
        assert made == mail.parse(case), case


def test_plain_headers_are_not_parsed_one_by_one(monkeypatch):
    """As it was, a message took the library's parser six times, at 1.6 ms of a core in all."""
    called, parse = [], headerregistry.HeaderRegistry.__call__
    monkeypatch.setattr(headerregistry.HeaderRegistry, "__call__", lambda self, name, value: called.append(name) or parse(self, name, value))
    for k in range(200):
        made = mail.parse(_raw({"From": "=?utf-8?q?=C3=85sa_B?= <ASA@X.example>", "To": f"b@y{k}.example, C <c@z.example>", "Message-ID": f"<{k}@x>", "Date": f"01 Jul {1980 + k % 140} 10:00:00 +0200", "Subject": f"Order {k}", "Content-Type": "text/plain; charset=utf-8"}))
        assert (made["message_id"], made["from_name"], made["subject"], len(made["recipients"])) == (f"<{k}@x>", "Åsa B", f"Order {k}", 2)
    assert len(called) <= 4


@pytest.mark.parametrize("content", [None, b"", b"Message-ID: <1@x>\nDate: 01 Jul 2001 10:00:00 +0200\n\nbody"])
def test_parsed_rows(spark, content):
    row = mail.parsed(spark.createDataFrame([("s", "p", content)], "sha256 string, path string, raw binary")).withColumn("sent_at", F.col("sent_at").cast("string")).first()
    want = (None, None, None, "no content") if content is None else ("<1@x>", "2001-07-01 08:00:00", "body", None) if content else (None, None, "", None)
    assert (row["message_id"], row["sent_at"], row["body"], row["error"]) == want
