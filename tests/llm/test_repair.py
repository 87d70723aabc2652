"""Repair of conversation structure against a program over whole audit strings."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from itertools import product

from archivolt.llm import queries, repair

NEXT = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
SCHEMA = "conv_id long, turn long, role string, text string"


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        visible = re.sub(r"[\x20\x09-\x0D]", "", text)
        fault = "blank" if not visible else "duplicate" if (role, text) in seen else "" if visible[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append(fault)
    return out


def plain(rows):
    """(cost, audit, repaired): the least of all, with whole audits and texts in every state."""
    best = {"0": (0, "", ())}

    def better(found, state, way):
        if state not in found or way[:2] < found[state][:2]:
            found[state] = way

    def inserted(layer):
        found = dict(layer)
        for _ in range(4):
            for state, (cost, audit, out) in list(found.items()):
                role = "assistant" if state == "u" else "user"
                better(found, NEXT[state, role[0]], (cost + 2, audit + "I", (*out, f"{role}:")))
        return found

    for (role, text), fault in zip(rows, faults_of(rows)):
        after = {}
        for state, (cost, audit, out) in inserted(best).items():
            better(after, state, (cost + 3, audit + "D", out))
            if fault not in ("blank", "duplicate"):
                late = fault == "truncated"
                if (state, role[:1]) in NEXT:
                    better(after, NEXT[state, role[:1]], (cost + late, audit + "K", (*out, f"{role}:{text}")))
                new = "assistant" if state == "u" else "user"
                better(after, NEXT[state, new[0]], (cost + 2 + late, audit + "R", (*out, f"{new}:{text}")))
        best = after
    return min(way for state, way in inserted(best).items() if state in "0a")


def every_way(rows, gap=2):
    """The least (cost, audit) of all audits of few rows, by trying each."""
    found, faults = [], faults_of(rows)
    for runs in product(*([[""] + ["".join(p) for n in range(1, gap + 1) for p in product("ua", repeat=n)]] * (len(rows) + 1))):
        for edits in product("DKua", repeat=len(rows)):
            cost, audit, roles = 0, "", ""
            for run, edit, (role, _), fault in zip(runs, edits, rows, faults):
                cost, audit, roles = cost + 2 * len(run), audit + "I" * len(run), roles + run
                if edit != "D" and fault in ("blank", "duplicate"):
                    cost = 10**6
                cost += (3 if edit == "D" else 0 if edit == "K" else 2) + (edit != "D" and fault == "truncated")
                audit += edit if edit in "DK" else "R"
                roles += "" if edit == "D" else role[0] if edit == "K" else edit
            cost, audit, roles = cost + 2 * len(runs[-1]), audit + "I" * len(runs[-1]), roles + runs[-1]
            if re.fullmatch("(s?(ua)+)?", roles):
                found.append((cost, audit))
    return min(found)


def digest_of(rows):
    """The contract's columns but conv_id, from rows (turn, role, text) in order."""
    turns = {t for t, _, _ in rows if t is not None}
    said = [(r, x) for _, r, x in rows]
    faults = faults_of(said)
    cost, audit, out = plain(said)
    illegal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in zip(said, said[1:]))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        out += [(conv, turn, "user" if draw == 4 else role, text)] * (0 if draw == 0 else 2 if draw == 3 else 1)
    return out


def expected(rows):
    held = damaged(rows)
    order = lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode())
    return {conv: digest_of([r[1:] for r in sorted((x for x in held if x[0] == conv), key=order)]) for conv in {r[0] for r in rows}}


def got(frame):
    columns = "gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
    return {r["conv_id"]: tuple(r[c] for c in columns) for r in frame.collect()}


def test_plain_program_is_the_least_of_all_ways():
    draw = random.Random(5)
    for _ in range(40):
        rows = [(draw.choice(["system", "user", "assistant", "tool"]), draw.choice(["", "a.", "b!", "c"])) for _ in range(draw.randint(0, 2))]
        assert plain(rows)[:2] == every_way(rows)


def test_layers_of_ranks_equal_whole_strings():
    draw = random.Random(7)
    layers = repair.Layers()
    for _ in range(400):
        rows = [(draw.choice(["system", "user", "user", "assistant", "tool", ""]), draw.choice(["", "a.", "b!", "c", "d?", "e"])) for _ in range(draw.randint(1, 40))]
        kinds = "".join(repair.kind_of(r[:1] or "x", {"blank": 1, "duplicate": 1, "truncated": 2, "": 0}[f]) for (r, _), f in zip(rows, faults_of(rows)))
        cuts = sorted({0, len(kinds), *(draw.randint(0, len(kinds)) for _ in range(draw.randint(0, 4)))})
        parts = [kinds[a:b] for a, b in zip(cuts, cuts[1:])]
        cost, states, tail = repair.joined([layers.table(p) for p in parts])
        audit = "".join(m for p, a, b in zip(parts, states, states[1:]) for m, _ in layers.edits(p, a, b)) + tail
        assert (cost, audit) == plain(rows)[:2]
    assert len(layers.known) < 3000  # few different layers, whatever the conversations


def test_query_against_plain_program(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.op11_conversation_repair(spark, sf)) == expected(rows)


def test_nulls_ties_repeats_long_texts_and_other_columns(spark):
    draw = random.Random(11)
    rows = [(draw.choice([1, 2, 3, None]), draw.choice([None, 1, 2, 3, 9]), draw.choice([None, "system", "user", "assistant", "", "Éa"]), draw.choice([None, "", " \t", "a", "a.", "b?", "é\n", "x" * 50_000])) for _ in range(160)]
    rows += [(4, 1, "user", "hi.")] * 30 + [(5, i, None, None) for i in range(3)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", conv string, at int")
    assert got(repair.digest(frame, *repair.repair(repair.damage(frame)))) == expected(rows)


def test_conversation_of_many_segments(spark, monkeypatch):
    monkeypatch.setattr(repair, "SEGMENT", 8)
    draw = random.Random(3)
    rows = [(7, i, draw.choice(["system", "user", "assistant"]), draw.choice(["ok.", "ok", f"{i}.", f"{i}", ""])) for i in range(700)] + [(8, 0, "user", "a.")]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(repair.digest(frame, *repair.repair(repair.damage(frame)))) == expected(rows)


def test_edits_leave_alternating_roles(spark):
    rows = [(1, 0, "assistant", "a."), (1, 1, "assistant", "b"), (1, 2, "system", "c."), (2, 0, "system", "only."), (3, 0, "user", "")]
    edits, summary = repair.repair(spark.createDataFrame(rows, SCHEMA))
    found = {}
    for r in edits.orderBy("conv", "at", "k").collect():
        found.setdefault(r["conv"]["conv_id"], []).append((r["edit"], r["role"], r["text"]))
    assert found[2] == [("D", None, None)] and found[3] == [("D", None, None)]
    assert {r["conv"]["conv_id"]: "".join(e for e, _, _ in found[r["conv"]["conv_id"]]) == r["audit"] for r in summary.collect()} == {1: True, 2: True, 3: True}
    assert re.fullmatch("(s?(ua)+)?", "".join(role[0] for edit, role, _ in found[1] if edit != "D"))


def test_conversations_without_rows_and_empty_tables(spark):
    gone = next(i for i in range(100) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    frame = spark.createDataFrame([(gone, 0, "user", "x.")], SCHEMA)
    assert got(repair.digest(frame, *repair.repair(repair.damage(frame)))) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    empty = spark.createDataFrame([], SCHEMA)
    assert repair.digest(empty, *repair.repair(repair.damage(empty))).count() == 0
