"""The draw of an answer key against a draw of one candidate after another."""

from __future__ import annotations

import hashlib
import random

import pytest

from archivolt.operators import cases, sampling

SHARES = {"m": {"bulk": 2.0, "plain": 1.0}, "p": {"recent": 2.0, "older": 1.0}, "c": {"window": 2.0}}


def one_by_one(rows, shares, n):
    queues = {g: sorted(((hashlib.md5(str(r[0]).encode()).hexdigest(), r) for r in rows if r[0] is not None and r[1] == g), key=lambda x: x[0]) for part in shares.values() for g in part}
    strata = sampling.split_by_share({s: sum(p.values()) for s, p in shares.items()}, n)
    want = {g: k for s, part in shares.items() for g, k in sampling.split_by_share(part, strata[s]).items()}
    got, used, out = dict.fromkeys(want, 0), set(), []

    def take(g):
        while queues[g]:
            _, (id_, _, *claims) = queues[g].pop(0)
            mine = {("id", id_), *((i, c) for i, c in enumerate(claims) if c is not None)}
            if mine & used:
                continue
            used.update(mine)
            out.append((id_, g))
            return True
        return False

    for g in want:
        while got[g] < want[g] and take(g):
            got[g] += 1
    for scope in ("stratum", "any"):
        for g in want:
            givers = [o for part in shares.values() for o in part if o != g and (scope == "any" or {o, g} <= set(next(p for p in shares.values() if g in p)))]
            turn = 0
            while got[g] < want[g] and givers:
                o = givers[turn % len(givers)]
                if take(o):
                    got[o], want[o], want[g], turn = got[o] + 1, want[o] + 1, want[g] - 1, turn + 1
                else:
                    givers.remove(o)
    return out


def got(frame):
    return [(r["id"], r["group"]) for r in frame.orderBy("position").collect()]


@pytest.mark.parametrize(("seed", "page"), [(1, None), (2, 2), (3, 3), (4, 1)])
def test_equals_a_draw_of_one_after_another(spark, seed, page):
    draw = random.Random(seed)
    groups = ["bulk"] * 8 + ["plain"] * 3 + ["recent"] + ["older"] * 2 + ["window"] * 2 + ["other"]
    rows = [(draw.choice([i, i, i, draw.randrange(40)]), draw.choice(groups), draw.choice([None, 0, 0, draw.randrange(30)]), draw.choice([None, f"p{draw.randrange(25)}"])) for i in range(160)]
    rows = list({r[:2]: r for r in rows}.values()) + [(None, "bulk", 99, "none")]
    pool = spark.createDataFrame(rows, "id long, group string, thread long, pattern string")
    for n in (7, 60):
        assert got(cases.answer_key(pool, ["thread", "pattern"], SHARES, n, page=page)) == one_by_one(rows, SHARES, n)


def test_a_chain_of_claims(spark):
    """b shares a claim with a, c with b alone: b is passed over and claims nothing, so c is drawn."""
    ids = sorted(range(3), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    rows = [(ids[0], "g", 1, None), (ids[1], "g", 1, "x"), (ids[2], "g", None, "x")]
    pool = spark.createDataFrame(rows, "id long, group string, thread long, pattern string")
    assert got(cases.answer_key(pool, ["thread", "pattern"], {"s": {"g": 1.0}}, 3)) == [(ids[0], "g"), (ids[2], "g")]


def test_one_claim_held_by_nearly_all_is_passed_in_one_page(spark, monkeypatch):
    pages, turn = [], cases._Draw._turn
    monkeypatch.setattr(cases._Draw, "_turn", lambda self, g: (pages.append(g), turn(self, g))[1])
    rows = [(i, "g", 5 if i % 400 else None) for i in range(4000)]
    pool = spark.createDataFrame(rows, "id long, group string, thread long")
    assert len(got(cases.answer_key(pool, ["thread"], {"s": {"g": 1.0}}, 11, page=4))) == 11
    assert len(pages) <= 11
