"""Secrets: base patterns against a plain search, formats against held-out credentials."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from archivolt.llm import queries, secrets


def brute(text: str) -> list[tuple[str, int, int]]:
    rows = []
    for rank, (kind, rx) in enumerate(
        (
            ("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
            ("access", r"AKIA[A-Z0-9]+"),
            ("hex", r"[0-9a-f]+"),
        )
    ):
        for m in re.finditer(rx, text):
            if {"assign": lambda m: len(m.group(2)) >= 12, "access": lambda m: len(m.group()) >= 18, "hex": lambda m: len(m.group()) >= 16}[kind](m):
                rows.append((m.start(), rank, kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(rows)]


HARD = [
    "Password = 'abcdefghijkl' PASSWD:short secret=\"0123456789abcdef0123\"",
    "api_key:aaaaaaaaaaaa apikey : bbbbbbbbbbbb to\u212aen=cccccccccccc token=token=dddddddddddd",
    "AKIAAKIAAKIAAKIA12 AKIA0123456789ABC 0123456789abcde 0123456789abcdefg",
    "é" * 30 + "deadbeefdeadbeef",
    "",
]


def test_base_spans(spark):
    for text in HARD:
        assert [s[:3] for s in secrets.scan(text, secrets.Scanner([])) if s[0] in ("assign", "access", "hex")] == brute(text)
    assert secrets.scan(None, secrets.Scanner([])) == []


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in queries.op5_secret_scans(spark, sf).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        want = brute(text)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(w[0] == k for w in want) for k in ("assign", "access", "hex")]


BASE = ("assign", "access", "hex")


@pytest.fixture(scope="module")
def scanner():
    return secrets.Scanner(secrets.learn(secrets.labelled()))


def added(text, scanner):
    return [s for s in secrets.scan(text, scanner) if s[0] not in BASE]


def test_automata_spell_their_formats(scanner):
    """The states of the marks are told apart, and those of random parts merged."""
    of = {a.name: a for a in scanner.automata}
    assert min(len(a.step) for a in of.values()) >= 4 and max(len(a.step) for a in of.values()) <= 60
    for name, first in (("forge_token", "g"), ("payment_key", "prs"), ("cloud_key_id", "A")):
        assert set(of[name].step[0]) == set(first)
    assert secrets.learn(secrets.labelled())[0] == scanner.automata[0]  # the same on every call


def test_held_out_credentials_are_found_and_ordinary_strings_are_not(scanner):
    held = secrets.labelled(examples=40, seed=99)
    right = sum((name, 4, 4 + len(c)) in [s[:3] for s in added(f"key {c} end", scanner)] for name, c in held)
    assert right >= 0.97 * len(held)
    plain = secrets.ordinary(3000, seed=55)
    draw = random.Random(3)
    plain += ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=draw.randint(3, 24))) for _ in range(3000)]
    plain += ["".join(draw.choices("0123456789ABCDEFGHIJ", k=30)) for _ in range(300)]
    assert not added(" ".join(plain), scanner)


@pytest.mark.parametrize("before,after", [("https://example.com/", ""), ("see ", "/repo"), ("run -", " now"), ("key_", "."), ("git+https://a:", "@host/x"), ("/home/user/", "+next"), ("(", "), or")])
def test_formats_inside_urls_paths_and_options(scanner, before, after):
    held = secrets.labelled(examples=40, seed=98)
    right = sum((name, len(before), len(before) + len(c)) in [s[:3] for s in added(f"{before}{c}{after}", scanner)] for name, c in held)
    assert right >= 0.95 * len(held)


def test_several_in_a_run_and_base_spans_are_scored(scanner):
    first, second = [c for name, c in secrets.labelled(examples=40, seed=98) if name == "forge_token"][:2]
    assert [s[1:3] for s in added(f"x/{first}/{second}", scanner)] == [(2, 42), (43, 83)]
    assert added("the path npm_modules/glpat-readme/sk_live_docs/index", scanner) == []
    got = secrets.scan(f"token={first} and password=correct-horse-battery", scanner)
    assert [s[:3] for s in got] == [("assign", 0, 46), ("forge_token", 6, 46), ("assign", 51, 81)]
    assert got[0][3] > 0.9 and got[2][3] == 0.0


def test_long_texts_are_read_once(scanner):
    token = next(c for name, c in secrets.labelled(examples=1, seed=98) if name == "payment_key")
    for filler in ("ghp_", "a", "1", "eyJhbGciOi.", "deadbeef", "xoxb-1-"):
        text = filler * (200_000 // len(filler)) + " " + token
        at = len(text) - len(token)
        assert (at, len(text)) in [s[1:3] for s in added(text, scanner)]


def test_states_merge_and_keep_the_format():
    made = secrets.infer("x", ["k-" + "ab" * n for n in range(8, 40) for _ in range(5)])
    assert len(made.step) < 40
    scanner = secrets.Scanner([made])
    assert [s[1:3] for s in added("see k-ababababababababababab.", scanner)] == [(4, 28)]
    assert not added("see z-ababababababababababab.", scanner)


def test_frames_with_nulls_repeats_and_extra_columns(spark):
    frame = spark.createDataFrame([(1, None, 5), (1, None, 5), (2, HARD[0], None)], "doc_id long, text string, kind int")
    got = secrets.find_secrets(frame).orderBy("doc_id").collect()
    assert [len(r["secrets"]) for r in got][:2] == [0, 0] and got[2]["secrets"] and got[0]["kind"] == 5
    assert secrets.find_secrets(frame.limit(0)).count() == 0
