from __future__ import annotations

import hashlib
import random
import re

from archivolt.llm import pii as P
from archivolt.llm import queries

ORDER = ("email", "ip", "card", "phone")


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        n = int(c) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def digits(s):
    return re.sub("[^0-9]", "", s)


RULES = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
}


def brute(text):
    out = []
    for kind in ORDER:
        pattern, valid = RULES[kind]
        out += [(kind, m.start(), m.end()) for m in re.finditer(pattern, text or "") if valid(m.group())]
    return out


def texts():
    rnd = random.Random(5)
    bits = ["a@b.co", "x@y.com_z@w.com", "a@b-c@d.e.f", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.02.3.255", "4111111111111111", "4111 1111-1111 1111", "4111  1111111111111111", "+1 (555) 123-4567", "+1234567", "+49 30 1234567890123", "é", "🙂", "@", "+", "..", "%a-@q.w", "999999999999999999999.1.1.1", "\n", "word ", " "]
    out = [None, "", "🙂 mail a@b.co, 4111111111111111"]
    out += ["".join(rnd.choice(bits) for _ in range(rnd.randrange(1, 14))) for _ in range(400)]
    out += ["".join(rnd.choice("a@.-+0123456789 ()é") for _ in range(rnd.randrange(60))) for _ in range(400)]
    return out


def test_base_spans_are_those_of_the_patterns(spark):
    rows = list(enumerate(texts()))
    frame = spark.createDataFrame([(i, t, 3) for i, t in rows], "doc_id long, text string, n_ip int")
    got = {r["doc_id"]: r for r in P.digest(P.find_pii(frame)).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        want = brute(t)
        r = got[i]
        said = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert [r[f"n_{k}"] for k in ORDER] == [sum(x[0] == k for x in want) for k in ORDER], t
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest(), t
        assert [x for x in r["spans"].split(",") if x.split(":")[0] in ORDER] == [x for x in said.split(",") if x]


def test_added_kinds_need_a_checksum_and_context(spark):
    rows = ["my IBAN is GB82 WEST 1234 5698 7654 32 thanks", "IBAN GB83 WEST 1234 5698 7654 32", "pay by amex card 378282246310005", "order 378282246310005", "GB82WEST12345698765432"]
    got = [r["spans"] for r in P.digest(P.find_pii(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))).orderBy("doc_id").collect()]
    assert [s.split(":")[0] for s in got] == ["iban", "", "shortcard", "", "iban"]


def test_redaction(spark):
    rows = [(1, "é write to a@b.co or +1 (555) 123-4567!"), (2, "nothing here"), (3, None), (4, ""), (5, "1.2.3.4"), (6, "+4111111111111111 x")]
    frame = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, kind string")
    out = P.redact(frame)
    assert out.columns == frame.columns
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got == {1: "é write to [EMAIL] or [PHONE]!", 2: "nothing here", 3: None, 4: "", 5: "[IP]", 6: "+[CARD] x"}


def test_no_python_in_the_plan(spark):
    frame = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = P.digest(P.find_pii(frame))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty(spark):
    assert P.digest(P.find_pii(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def test_long_runs_and_many_spans(spark):
    """Runs of a million, and spans by the thousand, none of which a recursing pattern or quadratic work would survive."""
    label = "a@b" + ".c" * 1_000_000
    mails = " ".join(f"u{i}@ex{i}.com" for i in range(20_000))
    cases = {
        "1" * 1_000_000: ([], None),
        "1 " * 500_000: ([], None),
        "x " + label: ([("email", 2, 2 + len(label))], "x [EMAIL]"),
        "a@" * 200_000: ([], None),
        "+1(" * 100_000: ([], None),
        mails: ([("email", m.start(), m.end()) for m in re.finditer("[^ ]+", mails)], " ".join(["[EMAIL]"] * 20_000)),
        "1." * 100_000: ([("ip", 8 * i, 8 * i + 7) for i in range(25_000)], "[IP]." * 25_000),
        "AB12" * 100_000: ([], None),
    }
    frame = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in P.digest(P.find_pii(frame)).collect()}
    clean = {r["doc_id"]: r["text"] for r in P.redact(frame).collect()}
    for i, (text, (want, redacted)) in enumerate(cases.items()):
        said = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert got[i]["base_sha256"] == hashlib.sha256(said.encode()).hexdigest(), text[:20]
        assert clean[i] == (text if redacted is None else redacted)


def test_context_reaches_over_other_matches(spark):
    rows = ["card a@b.co 1.2.3.4 378282246310005", "card" + " a@b.co" * 9 + " 378282246310005", "é" * 60 + " visa 378282246310005"]
    got = [r["spans"] for r in P.digest(P.find_pii(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))).orderBy("doc_id").collect()]
    assert ["shortcard" in s for s in got] == [True, False, True]


def test_redaction_merges_chains_of_spans_and_keeps_clashing_columns(spark):
    rnd = random.Random(8)
    rows = [(i, "".join(rnd.choice(["a@b.co", "+", "1.2.3.4", "4111111111111111", " ", "é", "(555) 123-4567", "x" * 1021]) for _ in range(rnd.randrange(12))), "mine") for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, __pii string")
    spans = {r["doc_id"]: r["pii"] for r in P.find_pii(frame).collect()}
    out = P.redact(frame)
    assert out.columns == frame.columns
    for r in out.collect():
        text, said, at = rows[r["doc_id"]][1], [], 0
        for s in sorted(spans[r["doc_id"]], key=lambda s: (s["start"], -s["end"], s["kind"].upper())):
            if s["start"] >= at:
                said += [text[at : s["start"]], f"[{s['kind'].upper()}]"]
            at = max(at, s["end"])
        assert r["text"] == "".join([*said, text[at:]]) and r["__pii"] == "mine"


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in queries.op10_personal_data(spark, sf).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        said = ",".join(f"{k}:{s}:{e}" for k, s, e in brute(t))
        assert got[i]["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
